"""Main text of web pages from flat text blocks and a decision tree.

A page is cut into flat blocks of text at its block tags. Each block carries its word count and
link density, those of its neighbours, and what its enclosing tags say (menu, header, footer,
sidebar, advert, form, comment, or article), how long the run of plain text is in which it stands, the
longest block of the page, and whether it stands beside an article that holds most text. A decision tree, trained when the job starts on the
small labelled table below, tells main text from the rest. Pages are worked on one by one inside
their partitions; nothing is shuffled.

Defined results: a null or empty page has an empty text; markup that is cut off at the end of a
page is dropped, text that is cut off is kept; a page of short blocks alone keeps all that are in no rest
part and no link; formulas are text, controls and drawings are not; very long texts are one block each; equal pages have equal texts; extra columns are
left aside; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from knotwork.llm.common import text_slices

# Tags and names of HTML.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary "
    "table tbody td tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
SKIPPED_TAGS = frozenset(
    "script style noscript template svg annotation annotation-xml iframe object canvas select textarea button title audio video datalist".split()
)
RAW_TAGS = frozenset("script style textarea title iframe noscript".split())
REST_TAGS = frozenset("nav header footer aside form menu dialog search".split())
REST_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
MAIN_TAGS = frozenset("article main".split())
# Words in class and id names of parts that are no main text.
REST_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adbox sponsor sponsored promo promotion banner masthead menu nav navbar navigation "
    "breadcrumb breadcrumbs sidebar aside widget footer footnav copyright cookie cookies consent gdpr notice notification alert popup "
    "modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment "
    "comments commentlist disqus respond reply replies pagination pager toolbar skip hidden disclaimer paywall donate feedback "
    "discussion header topbar reactions".split()
)
# Words beside which a name of the list above speaks of something else, as in "has-sidebar" or "article-header".
OTHER_NAMES = frozenset("has with without no article entry post story section content main".split())
# First words of names that speak of a state, a kind or a screen instead of the part itself.
QUALIFIERS = frozenset("has with without no not category tag type status format overflow sm md lg xl".split())
PREPOSITIONS = frozenset("by for from in of on to via".split())
# Last words of names that say only what box the part stands in.
BOX_WORDS = frozenset(
    "area articles author bar block body bottom box button buttons center col column container content date desktop entry fixed "
    "form frame group holder icon icons info inner inside item items label large law leaderboard left legal lg line link links "
    "list logo main md media message meta mobile module notice now outer panel part placeholder policy post posts primary recent "
    "rectangle right row secondary section skyscraper slot sm small stories text this title toggle top trail tray unit wrap "
    "wrapper xl xs zone".split()
)
# Skipped tags that cannot hold one of their own kind.
FLAT_TAGS = frozenset("button select datalist canvas audio video".split())
LEAST_PARAGRAPH = 8
WHOLE_TAGS = frozenset("html body main".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attributes>(?>=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(?:>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW_END = {name: re.compile(rf"</{name}\b", re.IGNORECASE) for name in RAW_TAGS}
_HREF = re.compile(r"(?:^|\s)href\s*=", re.IGNORECASE)
_BARE_END = re.compile(r"=\s*[^\s\"'=]+\s*\Z")
_SPACE = re.compile(r"\s+")
_NAME_PARTS = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")

# A labelled table of blocks: words, link density, words and link density of the block before and
# behind, inside a rest part, inside an article, heading; the words of the longest block in the run of
# plain text around it and on the whole page; outside the article; then 1 for main text.
LABELLED_BLOCKS = [
    # words, links, words before, links before, words behind, links behind, rest, article, heading,
    # longest of the run, longest of the page, outside the article, main
    (1, 1.0, 0, 0.0, 1, 1.0, 1, 0, 0, 0, 60, 0, 0),
    (2, 1.0, 1, 1.0, 2, 1.0, 1, 0, 0, 0, 60, 0, 0),
    (1, 1.0, 2, 1.0, 6, 0.0, 1, 0, 0, 0, 60, 0, 0),
    (3, 1.0, 1, 1.0, 40, 0.0, 0, 0, 0, 0, 60, 0, 0),
    (4, 1.0, 3, 1.0, 3, 1.0, 0, 0, 0, 0, 60, 0, 0),
    (2, 1.0, 60, 0.0, 2, 1.0, 0, 0, 0, 0, 60, 0, 0),
    (2, 1.0, 60, 0.0, 40, 0.0, 0, 0, 0, 0, 60, 0, 0),
    (7, 1.0, 30, 0.0, 50, 0.0, 0, 0, 0, 0, 60, 0, 0),
    (4, 1.0, 9, 1.0, 60, 0.0, 0, 0, 0, 0, 60, 0, 0),
    (6, 0.8, 12, 0.0, 0, 0.0, 0, 0, 0, 0, 60, 0, 0),
    (5, 1.0, 20, 0.0, 12, 0.0, 0, 0, 1, 0, 60, 0, 0),
    (12, 0.9, 4, 1.0, 9, 1.0, 0, 0, 0, 0, 60, 0, 0),
    (25, 0.8, 12, 0.9, 30, 0.7, 0, 0, 0, 0, 60, 0, 0),
    (6, 0.0, 1, 1.0, 9, 0.0, 1, 0, 0, 0, 60, 0, 0),
    (14, 0.0, 1, 1.0, 60, 0.0, 1, 0, 0, 0, 60, 0, 0),
    (45, 0.0, 2, 1.0, 80, 0.0, 1, 0, 0, 0, 60, 0, 0),
    (9, 0.1, 70, 0.0, 0, 0.0, 1, 0, 0, 0, 60, 0, 0),
    (30, 0.0, 90, 0.0, 20, 0.0, 1, 1, 0, 0, 60, 0, 0),
    (5, 0.0, 50, 0.0, 40, 0.0, 1, 1, 1, 0, 60, 0, 0),
    (60, 0.0, 30, 0.0, 50, 0.0, 1, 1, 0, 0, 60, 0, 0),
    (120, 0.0, 60, 0.0, 0, 0.0, 1, 0, 0, 0, 60, 0, 0),
    (3, 0.0, 2, 1.0, 3, 1.0, 0, 0, 0, 3, 60, 0, 0),
    (4, 0.0, 0, 0.0, 2, 1.0, 0, 0, 0, 4, 60, 0, 0),
    (5, 0.2, 3, 0.0, 4, 0.5, 0, 0, 0, 5, 60, 0, 0),
    (7, 0.0, 4, 0.0, 3, 0.0, 0, 0, 0, 7, 60, 0, 0),
    (2, 0.0, 60, 0.0, 6, 1.0, 0, 0, 0, 60, 60, 0, 0),
    (4, 0.0, 40, 0.0, 12, 1.0, 0, 0, 0, 40, 60, 0, 0),
    (3, 0.0, 8, 1.0, 9, 1.0, 0, 0, 0, 3, 60, 0, 0),
    (6, 0.0, 3, 1.0, 20, 0.8, 0, 0, 0, 6, 60, 0, 0),
    (3, 0.0, 50, 0.0, 5, 1.0, 0, 0, 1, 50, 60, 0, 0),
    (2, 0.0, 2, 1.0, 3, 1.0, 0, 0, 1, 2, 60, 0, 0),
    (4, 0.0, 3, 0.0, 5, 0.0, 0, 0, 0, 5, 60, 0, 0),
    (3, 0.0, 2, 1.0, 4, 0.0, 0, 0, 0, 4, 60, 0, 0),
    (6, 0.0, 5, 0.0, 0, 0.0, 0, 0, 0, 6, 60, 0, 0),
    (8, 0.0, 2, 1.0, 120, 0.0, 0, 1, 1, 120, 120, 0, 1),
    (5, 0.0, 14, 0.0, 40, 0.0, 0, 1, 1, 40, 60, 0, 1),
    (1, 0.0, 60, 0.0, 30, 0.0, 0, 1, 0, 60, 60, 0, 1),
    (2, 0.0, 6, 0.0, 12, 0.0, 0, 1, 0, 12, 60, 0, 1),
    (3, 0.0, 0, 0.0, 0, 0.0, 0, 1, 0, 3, 60, 0, 1),
    (12, 0.0, 8, 0.0, 25, 0.0, 0, 1, 0, 25, 60, 0, 1),
    (60, 0.0, 12, 0.0, 45, 0.0, 0, 1, 0, 60, 60, 0, 1),
    (140, 0.1, 60, 0.0, 9, 0.1, 0, 1, 0, 140, 140, 0, 1),
    (20, 0.5, 60, 0.0, 40, 0.0, 0, 1, 0, 60, 60, 0, 1),
    (4, 1.0, 40, 0.0, 60, 0.0, 0, 1, 0, 0, 60, 0, 1),
    (1, 0.0, 30, 0.0, 1, 1.0, 0, 1, 0, 30, 60, 0, 1),
    (8, 0.0, 60, 0.0, 3, 1.0, 0, 1, 0, 60, 60, 0, 1),
    (18, 0.0, 40, 0.0, 6, 1.0, 0, 1, 0, 40, 60, 0, 1),
    (3, 0.0, 60, 0.0, 4, 1.0, 0, 1, 1, 60, 60, 0, 1),
    (9, 0.0, 2, 1.0, 5, 1.0, 0, 1, 1, 9, 60, 0, 1),
    (3, 1.0, 3, 0.0, 3, 1.0, 0, 1, 0, 0, 60, 0, 1),
    (6, 1.0, 4, 1.0, 2, 1.0, 0, 1, 0, 0, 60, 0, 1),
    (2, 1.0, 6, 1.0, 1, 1.0, 0, 1, 0, 0, 60, 0, 1),
    (25, 0.9, 8, 1.0, 20, 0.9, 0, 1, 0, 0, 60, 0, 1),
    (6, 0.0, 3, 1.0, 80, 0.0, 0, 0, 1, 80, 80, 0, 1),
    (9, 0.0, 50, 0.0, 40, 0.0, 0, 0, 1, 50, 60, 0, 1),
    (18, 0.0, 9, 0.0, 60, 0.0, 0, 0, 0, 60, 60, 0, 1),
    (40, 0.0, 2, 1.0, 3, 1.0, 0, 0, 0, 40, 60, 0, 1),
    (80, 0.1, 40, 0.0, 10, 0.0, 0, 0, 0, 80, 80, 0, 1),
    (25, 0.0, 70, 0.0, 2, 1.0, 0, 0, 0, 70, 70, 0, 1),
    (8, 0.0, 60, 0.0, 50, 0.0, 0, 0, 0, 60, 60, 0, 1),
    (11, 0.0, 30, 0.0, 90, 0.0, 0, 0, 0, 90, 90, 0, 1),
    (20, 0.0, 20, 0.0, 1, 0.0, 0, 0, 0, 20, 60, 0, 1),
    (20, 0.0, 2, 0.0, 20, 0.0, 0, 0, 0, 20, 60, 0, 1),
    (22, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 22, 60, 0, 1),
    (15, 0.0, 1, 1.0, 1, 0.0, 0, 0, 0, 15, 60, 0, 1),
    (1, 0.0, 30, 0.0, 25, 0.0, 0, 0, 0, 30, 60, 0, 1),
    (4, 0.0, 60, 0.0, 40, 0.0, 0, 0, 0, 60, 60, 0, 1),
    (7, 0.0, 12, 0.0, 18, 0.0, 0, 0, 0, 18, 60, 0, 1),
    (5, 0.0, 20, 0.0, 4, 0.0, 0, 0, 0, 20, 60, 0, 1),
    (4, 0.0, 60, 0.0, 0, 0.0, 0, 0, 0, 60, 60, 0, 1),
    (3, 0.0, 45, 0.0, 30, 0.0, 0, 0, 1, 45, 60, 0, 1),
    (2, 0.0, 0, 0.0, 20, 0.0, 0, 0, 1, 20, 60, 0, 1),
    (4, 0.0, 2, 1.0, 15, 0.0, 0, 0, 1, 15, 60, 0, 1),
    (5, 0.0, 3, 0.0, 12, 0.0, 0, 0, 1, 12, 60, 0, 1),
    (10, 0.0, 50, 0.0, 2, 1.0, 0, 0, 0, 50, 60, 0, 1),
    (8, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 8, 60, 0, 1),
    (9, 0.0, 3, 0.0, 4, 0.0, 0, 0, 0, 9, 60, 0, 1),
    (8, 0.0, 9, 0.0, 2, 0.0, 0, 0, 0, 9, 60, 0, 1),
    (3, 0.0, 6, 0.0, 6, 0.0, 0, 0, 1, 6, 60, 0, 1),
    (3, 0.0, 40, 0.0, 8, 0.0, 0, 0, 0, 40, 60, 0, 1),
    (2, 0.0, 15, 0.0, 9, 0.0, 0, 0, 0, 15, 60, 0, 1),
    (2, 0.0, 30, 0.0, 8, 0.0, 0, 0, 1, 30, 60, 0, 1),
    (25, 0.4, 40, 0.0, 30, 0.0, 0, 0, 0, 40, 60, 0, 1),
    (60, 0.3, 20, 0.0, 15, 0.1, 0, 0, 0, 60, 60, 0, 1),
    (12, 0.3, 30, 0.0, 25, 0.2, 0, 0, 0, 30, 60, 0, 1),
    (8, 1.0, 40, 0.0, 20, 0.0, 0, 0, 0, 0, 60, 0, 1),
    (14, 0.9, 2, 1.0, 30, 0.0, 0, 0, 0, 0, 60, 0, 1),
    (30, 1.0, 50, 0.0, 0, 0.0, 0, 0, 0, 0, 60, 0, 1),
    (2, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 2, 2, 0, 1),
    (1, 0.0, 0, 0.0, 3, 0.0, 0, 0, 1, 3, 3, 0, 1),
    (3, 0.0, 1, 0.0, 0, 0.0, 0, 0, 0, 3, 3, 0, 1),
    (5, 0.0, 2, 1.0, 4, 0.0, 0, 0, 0, 5, 5, 0, 1),
    (4, 0.0, 5, 0.0, 2, 1.0, 0, 0, 0, 7, 7, 0, 1),
    (1, 0.0, 1, 0.0, 6, 0.0, 0, 0, 0, 6, 6, 0, 1),
    (3, 1.0, 4, 0.0, 5, 0.0, 0, 0, 0, 0, 5, 0, 0),
    (2, 0.0, 3, 0.0, 3, 0.0, 1, 0, 0, 0, 4, 0, 0),
    (1, 0.0, 1, 0.0, 1, 0.0, 0, 0, 0, 60, 60, 0, 1),
    (1, 0.0, 1, 0.0, 5, 0.0, 0, 0, 0, 40, 60, 0, 1),
    (5, 0.0, 1, 0.0, 0, 0.0, 0, 0, 0, 60, 60, 0, 1),
    (2, 0.0, 3, 0.0, 2, 0.0, 0, 0, 0, 30, 60, 0, 1),
    (4, 0.0, 6, 0.0, 3, 0.0, 0, 0, 0, 50, 60, 0, 1),
    (1, 0.0, 2, 0.0, 2, 0.0, 0, 0, 0, 20, 60, 0, 1),
    (3, 0.0, 3, 0.0, 0, 0.0, 0, 0, 0, 25, 60, 0, 1),
    (6, 0.0, 4, 0.0, 5, 0.0, 0, 0, 0, 80, 80, 0, 1),
    (2, 0.0, 1, 1.0, 1, 0.0, 0, 0, 0, 3, 60, 0, 0),
    (1, 0.0, 2, 0.0, 2, 0.0, 0, 0, 0, 2, 60, 0, 0),
    (30, 0.0, 60, 0.0, 4, 1.0, 0, 0, 0, 60, 60, 1, 0),
    (12, 0.0, 2, 1.0, 8, 0.0, 0, 0, 0, 12, 60, 1, 0),
    (60, 0.0, 40, 0.0, 30, 0.0, 0, 0, 0, 60, 80, 1, 0),
    (3, 0.0, 8, 0.0, 50, 0.0, 0, 0, 1, 50, 60, 1, 0),
    (9, 0.0, 0, 0.0, 60, 0.0, 0, 0, 0, 60, 60, 1, 0),
    (20, 0.1, 0, 0.0, 5, 0.0, 0, 0, 0, 20, 60, 1, 0),
    (4, 0.0, 20, 0.0, 40, 0.0, 0, 0, 0, 40, 60, 1, 0),
    (120, 0.0, 60, 0.0, 0, 0.0, 0, 0, 0, 120, 120, 1, 0),
    (15, 1.0, 30, 0.0, 12, 0.0, 0, 0, 0, 0, 60, 1, 0),
    (10, 0.9, 60, 0.0, 0, 0.0, 0, 0, 0, 0, 60, 1, 0),
    (1, 0.0, 0, 0.0, 0, 0.0, 0, 1, 0, 1, 8, 0, 1),
    (2, 0.0, 2, 0.0, 2, 0.0, 0, 1, 0, 2, 8, 0, 1),
    (1, 1.0, 0, 0.0, 0, 0.0, 0, 1, 0, 0, 8, 0, 1),
    (5, 0.0, 0, 0.0, 3, 0.0, 0, 1, 1, 5, 8, 0, 1),
    (1, 0.0, 1, 1.0, 1, 1.0, 0, 1, 0, 1, 60, 0, 1),
    (3, 0.0, 7, 1.0, 18, 1.0, 0, 1, 1, 3, 60, 0, 1),
    (7, 0.5, 1, 1.0, 60, 1.0, 0, 1, 0, 7, 60, 0, 1),
    (1, 1.0, 1, 1.0, 1, 1.0, 0, 1, 0, 0, 60, 0, 1),
    (3, 1.0, 60, 0.0, 60, 0.0, 0, 1, 0, 0, 60, 0, 1),
    (7, 1.0, 3, 1.0, 0, 0.0, 0, 1, 0, 0, 8, 0, 1),
    (8, 0.5, 18, 1.0, 3, 0.5, 0, 1, 0, 8, 8, 0, 1),
    (18, 1.0, 0, 0.0, 0, 0.0, 0, 1, 0, 0, 8, 0, 1),
    (18, 0.5, 8, 0.0, 8, 1.0, 0, 1, 0, 18, 60, 0, 1),
    (60, 1.0, 60, 1.0, 60, 1.0, 0, 1, 0, 0, 60, 0, 1),
    (60, 0.0, 0, 0.0, 0, 0.0, 0, 1, 0, 60, 60, 0, 1),
    (3, 0.0, 60, 0.0, 0, 0.0, 0, 1, 0, 60, 60, 0, 1),
    (1, 0.0, 18, 0.0, 7, 0.5, 0, 1, 0, 18, 60, 0, 1),
    (2, 0.5, 3, 1.0, 3, 1.0, 0, 1, 0, 2, 8, 0, 1),
    (4, 0.0, 3, 1.0, 1, 1.0, 0, 1, 0, 4, 60, 0, 1),
    (6, 0.0, 60, 0.0, 8, 1.0, 0, 1, 0, 60, 60, 0, 1),
    (1, 0.0, 60, 0.0, 1, 1.0, 0, 0, 0, 60, 60, 0, 0),
    (1, 0.0, 20, 0.0, 2, 1.0, 0, 0, 0, 60, 60, 0, 0),
    (3, 0.0, 20, 0.0, 3, 1.0, 0, 0, 0, 60, 60, 0, 0),
    (5, 0.0, 60, 0.0, 4, 1.0, 0, 0, 1, 60, 60, 0, 0),
    (19, 1.0, 0, 0.0, 19, 0.0, 0, 0, 0, 0, 60, 0, 1),
    (40, 1.0, 20, 0.0, 30, 0.0, 0, 0, 0, 0, 60, 0, 1),
    (10, 1.0, 30, 0.0, 10, 1.0, 0, 0, 0, 0, 60, 0, 0),
    (9, 1.0, 10, 1.0, 0, 0.0, 0, 0, 0, 0, 60, 0, 0),
    (1, 1.0, 0, 0.0, 2, 0.0, 1, 0, 0, 0, 2, 0, 0),
    (1, 0.0, 2, 0.0, 0, 0.0, 1, 0, 0, 0, 2, 0, 0),
    (3, 0.0, 3, 0.0, 2, 1.0, 1, 0, 0, 0, 3, 0, 0),
    (6, 0.0, 5, 0.0, 0, 0.0, 1, 0, 0, 0, 7, 0, 0),
    (40, 1.0, 0, 0.0, 20, 0.0, 1, 0, 0, 0, 60, 0, 0),
    (20, 0.9, 10, 1.0, 20, 0.0, 1, 0, 0, 0, 60, 0, 0),
    (60, 1.0, 2, 1.0, 60, 0.0, 1, 0, 0, 0, 60, 0, 0),
    (14, 1.0, 20, 0.0, 0, 0.0, 1, 0, 0, 0, 20, 0, 0),
    (8, 0.0, 40, 0.0, 20, 0.0, 1, 0, 0, 0, 60, 0, 0),
    (10, 0.5, 45, 0.0, 60, 0.0, 1, 0, 1, 0, 60, 0, 0),
    (18, 0.0, 3, 1.0, 18, 0.5, 1, 1, 0, 0, 20, 0, 0),
    (3, 1.0, 45, 0.0, 3, 0.0, 1, 1, 0, 0, 60, 0, 0),
    (90, 0.0, 0, 0.0, 0, 0.0, 1, 0, 0, 0, 0, 0, 0),
    (7, 0.0, 0, 0.0, 0, 0.0, 1, 0, 0, 0, 0, 0, 0),
    (15, 0.0, 60, 0.0, 10, 0.0, 1, 0, 0, 0, 60, 1, 0),
    (2, 0.0, 7, 0.0, 40, 0.0, 1, 0, 1, 0, 60, 1, 0),
    (1, 1.0, 2, 0.0, 0, 0.0, 0, 0, 0, 0, 2, 0, 0),
    (2, 1.0, 0, 0.0, 3, 0.0, 0, 0, 0, 0, 3, 0, 0),
    (1, 1.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 0, 0, 0),
    (7, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 7, 7, 0, 1),
    (6, 0.0, 1, 0.0, 3, 0.0, 0, 0, 0, 6, 6, 0, 1),
    (3, 0.0, 7, 0.0, 0, 0.0, 0, 0, 0, 7, 7, 0, 1),
    (4, 0.0, 0, 0.0, 6, 0.0, 0, 0, 1, 6, 6, 0, 1),
    (5, 0.0, 0, 0.0, 3, 0.0, 0, 0, 0, 5, 8, 0, 0),
    (6, 0.0, 0, 0.0, 3, 0.0, 0, 0, 0, 6, 8, 0, 0),
    (2, 0.0, 3, 0.0, 2, 0.0, 0, 0, 0, 4, 8, 0, 0),
    (7, 0.0, 1, 1.0, 2, 1.0, 0, 0, 0, 7, 8, 0, 0),
    (1, 0.0, 20, 0.0, 1, 1.0, 0, 0, 0, 20, 20, 0, 0),
    (2, 0.0, 15, 0.0, 2, 1.0, 0, 0, 0, 15, 15, 0, 0),
    (3, 0.0, 10, 0.0, 3, 1.0, 0, 0, 0, 10, 10, 0, 0),
    (20, 0.0, 20, 0.0, 9, 1.0, 0, 0, 0, 20, 20, 0, 1),
    (12, 0.0, 30, 0.0, 8, 1.0, 0, 0, 0, 60, 60, 0, 1),
    (30, 0.0, 40, 0.0, 12, 1.0, 0, 0, 0, 60, 60, 0, 1),
    (10, 0.0, 60, 0.0, 20, 1.0, 0, 0, 0, 60, 60, 0, 1),
    (16, 0.0, 10, 0.0, 30, 1.0, 0, 0, 0, 16, 20, 0, 1),
    (9, 1.0, 9, 1.0, 9, 1.0, 0, 0, 0, 0, 20, 0, 0),
    (15, 1.0, 20, 0.0, 15, 1.0, 0, 0, 0, 0, 60, 0, 0),
    (9, 1.0, 20, 0.0, 1, 1.0, 0, 0, 0, 0, 20, 0, 0),
    (11, 1.0, 40, 0.0, 2, 1.0, 0, 0, 0, 0, 60, 0, 0),
    (22, 1.0, 2, 1.0, 22, 1.0, 0, 0, 0, 0, 60, 0, 0),
    (12, 0.0, 60, 0.0, 6, 1.0, 0, 0, 0, 60, 60, 1, 0),
    (24, 0.0, 60, 0.0, 8, 1.0, 0, 0, 0, 60, 60, 1, 0),
]


def train_tree(table: list[tuple], depth: int = 12):
    """A classification tree by Gini gain: a label, or (feature, cut, below or equal, above)."""
    rows = np.array(table, dtype=float)
    x, y = rows[:, :-1], rows[:, -1]
    if depth == 0 or y.min() == y.max():
        return int(y.mean() >= 0.5)
    best = None
    for feature in range(x.shape[1]):
        values = np.unique(x[:, feature])
        for cut in (values[1:] + values[:-1]) / 2:
            low = x[:, feature] <= cut
            impurity = sum(part.sum() * y[part].mean() * (1 - y[part].mean()) for part in (low, ~low))
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, feature, cut, low)
    if best is None:
        return int(y.mean() >= 0.5)
    _, feature, cut, low = best
    return feature, cut, train_tree(rows[low], depth - 1), train_tree(rows[~low], depth - 1)


def classify(tree, row) -> int:
    while not isinstance(tree, int):
        feature, cut, low, high = tree
        tree = low if row[feature] <= cut else high
    return tree


def _is_rest(name: str, attributes: str) -> bool:
    """Whether a tag and its attributes, names aside, mark a part that is no main text."""
    if name in REST_TAGS:
        return True
    if not attributes or attributes.isspace():
        return False
    for key, double, single, bare in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), double or single or bare
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE):
            return True
        if key == "data-ad" or key.startswith("data-ad-"):
            return True
        if key == "role" and value.lower() in REST_ROLES:
            return True
    return False


def _rest_token(token: str) -> bool:
    """Whether one class or id name, or its head word, is a name of ``REST_NAMES``."""
    parts = [p.lower() for p in _NAME_PARTS.split(token) if p]
    if not parts or (len(parts) > 1 and parts[0] in QUALIFIERS):
        return False
    if "".join(parts) in REST_NAMES:
        return True
    others = OTHER_NAMES.intersection(parts)
    for place, part in enumerate(parts):
        if place and part in PREPOSITIONS:
            del parts[place:]
            break
    # The head is the last word that says more than where or what kind of box it is.
    while len(parts) > 1 and (len(parts[-1]) == 1 or parts[-1] in BOX_WORDS) and parts[-1] not in REST_NAMES:
        parts.pop()
    head = parts[-1] if parts[-1] in REST_NAMES else parts[-1].removesuffix("s")
    return head in REST_NAMES and not (head in ("header", "sidebar", "footer") and others)


def _names_rest(name: str, attributes: str) -> bool:
    """Whether the class and id names of a tag mark a part that is no main text."""
    if name in WHOLE_TAGS or not attributes or attributes.isspace():
        return False
    for key, double, single, bare in _ATTRIBUTE.findall(attributes):
        if key.lower() in ("class", "id") and any(map(_rest_token, (double or single or bare).split())):
            return True
    return False


class _Part:
    """An open tag and what it says about the text in it.

    ``named`` is set by names; ``inner`` only by names that no article or main element inside outranks.
    """

    __slots__ = ("name", "rest", "named", "inner", "article", "nested")

    def __init__(self, name: str, rest: bool, named: bool, inner: bool, article: bool, nested: bool):
        self.name, self.rest, self.named, self.inner, self.article, self.nested = name, rest, named, inner, article, nested


def _tags(page: str) -> list[tuple[int, int, bool, str | None, str]]:
    """Start, end, closing, name, attributes of each tag; raw contents belong to their open tag."""
    out: list[tuple[int, int, bool, str | None, str]] = []
    at, endless = 0, set()
    for tag in iter(lambda: _TAG.search(page, at), None):
        name, at = tag["name"], tag.end()
        if name is None:
            out.append((tag.start(), at, False, None, ""))
            continue
        name = name.lower()
        if name in RAW_TAGS and not tag["close"]:
            end = None if name in endless else _RAW_END[name].search(page, at)
            if end is not None:
                at = end.start()
            else:
                endless.add(name)
                if not _closes_itself(tag["attributes"]):
                    at = len(page)
        out.append((tag.start(), at, bool(tag["close"]), name, tag["attributes"]))
    return out


def _closes_itself(attributes: str) -> bool:
    """Whether a tag ends in a slash that is no part of an unquoted value."""
    return attributes.rstrip().endswith("/") and not _BARE_END.search(attributes)


def _unclosed(tags: list[tuple[int, int, bool, str | None, str]]) -> set[int]:
    """Starts of the skipped tags that have no close tag of their own."""
    open_tags: dict[str, list[int]] = {}
    out: set[int] = set()
    for start, _, close, name, attributes in tags:
        if name not in SKIPPED_TAGS or name in RAW_TAGS:
            continue
        mine = open_tags.setdefault(name, [])
        if close:
            if mine:
                mine.pop()
        elif not _closes_itself(attributes):
            if name in FLAT_TAGS:
                out.update(mine)
                mine.clear()
            mine.append(start)
    return out.union(*open_tags.values())


def _wrapping(tags: list[tuple[int, int, bool, str | None, str]]) -> set[int]:
    """Starts of the links that are closed: what they enclose is linked, blocks included."""
    out: set[int] = set()
    opened = None
    for start, _, close, name, attributes in tags:
        if name == "a":
            if close and opened is not None:
                out.add(opened)
            opened = None if close or not _HREF.search(attributes) else start
    return out


def blocks(page: str) -> list[tuple[str, int, int, bool, bool, bool]]:
    """Text, words, linked words, rest, article, heading of each flat block in page order.

    A skipped part ends with its close tag, at the latest with the block it stands in; one that is
    never closed ends at the next block tag. A part named like a menu or an advert is rest; where
    that leaves no paragraph of an article or main element, these elements outrank such names on
    them and around them.
    """
    out: list[tuple[str, int, int, bool, bool, bool, bool]] = []
    stack: list[_Part] = []
    text: list[str] = []
    linked: list[str] = []
    # Open skipped parts: name, blocks open around it, whether it ends at the next block tag.
    skips: list[tuple[str, int, bool]] = []
    links, heading, at = 0, False, 0
    # Whether the open link reaches over the next blocks.
    wraps = False

    def flush() -> None:
        if text:
            plain = _SPACE.sub(" ", "".join(text)).strip()
            if plain:
                top = stack[-1] if stack else None
                words = plain.count(" ") + 1
                rest, lifted = bool(top and (top.rest or top.named)), bool(top and (top.rest or top.inner))
                out.append((plain, words, min(words, len("".join(linked).split())), rest, bool(top and top.article), heading, lifted))
        text.clear()
        linked.clear()

    def say(raw: str) -> None:
        if raw and not skips:
            plain = html.unescape(raw) if "&" in raw else raw
            text.append(plain)
            if links:
                linked.append(plain)

    tags = _tags(page)
    unclosed, wrapping = _unclosed(tags), _wrapping(tags)
    for start, end, close, name, attributes in tags:
        say(page[at:start])
        at = end
        if name is None:
            continue
        if name in BLOCK_TAGS:
            while skips and skips[-1][2]:
                skips.pop()
        if close:
            if name in SKIPPED_TAGS:
                for place in range(len(skips) - 1, -1, -1):
                    if skips[place][0] == name and not skips[place][2]:
                        del stack[skips[place][1] :]
                        del skips[place:]
                        break
            elif name == "a":
                links, wraps = 0, False
            elif name in BLOCK_TAGS:
                flush()
                if name[0] == "h" and name[1:].isdigit():
                    heading = False
                for depth in range(len(stack) - 1, -1, -1):
                    if stack[depth].name == name:
                        del stack[depth:]
                        while skips and skips[-1][1] > depth:
                            skips.pop()
                        break
            continue
        if name in SKIPPED_TAGS:
            if name not in RAW_TAGS and not _closes_itself(attributes):
                skips.append((name, len(stack), start in unclosed))
        elif name == "br":
            say(" ")
        elif name == "a":
            links, wraps = 1, start in wrapping
        elif name in BLOCK_TAGS:
            flush()
            if not wraps:
                links = 0
            if name in VOID_TAGS:
                continue
            heading = name[0] == "h" and name[1:].isdigit()
            if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option") or heading:
                # These end where the next of their kind begins.
                if stack and stack[-1].name == name and not (skips and skips[-1][1] >= len(stack)):
                    stack.pop()
            top = stack[-1] if stack else None
            article = bool(top and top.article) or name in MAIN_TAGS
            # The headline of an article may stand in a header of its own.
            rest = bool(top and top.rest) or (_is_rest(name, attributes) and not (name == "header" and article))
            hit = _names_rest(name, attributes) and not (name == "header" and article)
            named, inner, nested = bool(top and top.named) or hit, bool(top and top.inner) or hit, bool(top and top.nested)
            if name in MAIN_TAGS and not nested:
                inner = False
            if name not in ("html", "body"):
                stack.append(_Part(name, rest, named, inner, article, nested or name == "article"))
    say(page[at:])
    flush()
    told = any(b[4] and not b[3] and not b[5] and b[1] >= LEAST_PARAGRAPH and 2 * b[2] < b[1] for b in out)
    return [(*b[:3], b[3] if told else b[6], *b[4:6]) for b in out]


def _plain(block: tuple) -> bool:
    """Whether a block is text of its own: in no rest part and not mostly links."""
    return not block[3] and 2 * block[2] <= block[1]


def _outside(found: list[tuple]) -> list[bool]:
    """Which blocks stand beside the article or main elements, where these hold most of the plain text.

    A heading right before such an element is its headline.
    """
    inside = sum(b[1] for b in found if b[4] and _plain(b))
    beside = sum(b[1] for b in found if not b[4] and _plain(b))
    if inside < max(beside, LEAST_PARAGRAPH):
        return [False] * len(found)
    return [not b[4] and not (b[5] and any(n[4] for n in found[i + 1 : i + 2])) for i, b in enumerate(found)]


def features(found: list[tuple]) -> list[tuple]:
    """The columns of ``LABELLED_BLOCKS`` but the label, for each block."""
    rows = []
    outside = _outside(found)
    longest = max((b[1] for b in found if _plain(b)), default=0)
    if any(b[4] and _plain(b) for b in found):
        # Beside an article, however short, short blocks are no page of their own.
        longest = max(longest, LEAST_PARAGRAPH)
    runs, start = [0] * len(found), 0
    for i in range(len(found) + 1):
        if i == len(found) or not _plain(found[i]):
            runs[start:i] = [max((b[1] for b in found[start:i]), default=0)] * (i - start)
            start = i + 1
    for i, (_, words, linked, rest, article, heading) in enumerate(found):
        before = found[i - 1] if i else (None, 0, 0)
        behind = found[i + 1] if i + 1 < len(found) else (None, 0, 0)
        near = [value for _, w, n, *_ in (before, behind) for value in (w, n / w if w else 0.0)]
        rows.append((words, linked / words, *near, int(rest), int(article), int(heading), runs[i], longest, int(outside[i])))
    return rows


def main_text(page: str, tree) -> str:
    found = blocks(page)
    return "\n".join(block[0] for block, row in zip(found, features(found)) if classify(tree, row))


def extract_pages(pages: DataFrame, table: list[tuple] | None = None) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks for every row of ``pages`` (page_id, url, html)."""
    tree = train_tree(LABELLED_BLOCKS if table is None else table)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "html"):
            texts = [main_text(page or "", tree) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    rows = pages.selectExpr("CAST(page_id AS long) AS page_id", "CAST(url AS string) AS url", "html")
    return rows.mapInArrow(work, "page_id long, url string, text string, n_chars long")
