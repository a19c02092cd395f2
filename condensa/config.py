"""Engine configuration: fixed values, defaults and the routing rules.

Everything here is a literal used when expressions are built; nothing is read per row
from Python.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

# ---------------------------------------------------------------------------
# Fixed values. These must equal the values of the system we reproduce, or the
# results differ. They are stated as plain text, in their natural order.
# ---------------------------------------------------------------------------

# Stop words dropped by the term tokeniser (94 words).
STOP_WORDS = [
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "being",
    "have", "has", "had", "do", "does", "did", "will", "would", "could",
    "should", "may", "might", "shall", "can", "need", "dare", "ought",
    "used", "to", "of", "in", "for", "on", "with", "at", "by", "from",
    "as", "into", "through", "during", "before", "after", "above", "below",
    "between", "out", "off", "over", "under", "again", "further", "then",
    "once", "here", "there", "when", "where", "why", "how", "all", "each",
    "every", "both", "few", "more", "most", "other", "some", "such", "no",
    "nor", "not", "only", "own", "same", "so", "than", "too", "very",
    "just", "because", "but", "and", "or", "if", "while", "about",
    "this", "that", "these", "those", "it", "its",
]

# Substrings that mark a page-snapshot block.
DOM_SIGNALS = ["[ref=", "- role:", 'role="', "aria-"]

# Tool-name substrings of known screenshot tools.
SCREENSHOT_TOOLS = ["browser_take_screenshot", "browser_screenshot", "screenshot", "take_screenshot"]

# Image-path pattern searched in text blocks (case-insensitive; the bare "]" is
# escaped for Java and RE2).
FILE_PATH_PATTERN = (
    r"""(?i)(?:\]\(|href=["']?|src=["']?)?/?(?:/[\w./-]+\.(?:png|jpg|jpeg|gif|webp|svg|bmp|tiff))"""
)

# Snapshot roles.
INTERACTIVE_ROLES = [
    "button", "link", "combobox", "textbox", "checkbox", "radio",
    "menuitem", "menuitemcheckbox", "menuitemradio", "option",
    "searchbox", "slider", "spinbutton", "switch", "tab", "treeitem",
]
TRANSPARENT_ROLES = ["generic", "none", "presentation", "group", "rowgroup"]
SECTION_ROLES = ["banner", "main", "navigation", "complementary", "region", "form"]
FOOTER_ROLES = ["contentinfo"]
NOISE_ROLES = ["generic", "none", "presentation"]
SNAPSHOT_ATTRS = ["disabled", "selected", "active", "required", "checked", "expanded", "pressed", "readonly"]

# Numeric constants.
JSON_MIN_TOKENS = 500            # JSON-looking blocks above this are large-json
DEFAULT_TEXT_THRESHOLD = 100_000  # large-text threshold in tokens
CHUNK_TARGET_TOKENS = 512
CHUNK_OVERLAP_TOKENS = 50
CHUNK_SEPARATORS = ["\n\n", "\n", ". ", " "]
BM25_K1 = 1.5
BM25_B = 0.75
TRUNCATE_RATIO = 0.5
HEAD_TOKENS = 10_000
TAIL_TOKENS = 5_000
NEWLINE_WINDOW = 200             # boundary moves to a newline within +-200 chars
MIN_MIDDLE_TARGET = 1_000
MIN_SECOND_PASS_INPUT = 5_000
JSON_MAX_ARRAY_ITEMS = 3
JSON_MAX_DEPTH = 5
JSON_ARRAY_THRESHOLD = 10
TABLE_MAX_ROWS = 100
TABLE_MAX_COLS = 15
TABULAR_SAMPLE_ROWS = 20
TABULAR_MIN_SCALAR_SHARE = 0.7
CELL_MAX_CHARS = 80
CELL_CUT_CHARS = 77
MIN_MEANINGFUL_CHARS = 7
GROWTH_LIMIT = 1.1
HISTORY_SIZE = 10
RECENT_CALLS = 3
INHERITED_CALLS = 2
ARG_VERBATIM_MAX = 200
LOG_ARG_MAX = 200
PREVIEW_BLOCK_CHARS = 300
PREVIEW_MAX_CHARS = 500
PREVIEW_SEPARATOR = "\n---\n"

DEFAULT_COMPRESSION_PROMPT = (
    "Shorten this tool output while preserving all useful information.\n"
    "Keep ALL: code blocks, file paths, URLs, error messages, data structures, identifiers, numbers, dates.\n"
    "Remove: redundant explanations, boilerplate, verbose prose, repeated information.\n"
    "Preserve original structure and ordering. When in doubt, keep the information.\n"
    "Do NOT add commentary about the compression. Output ONLY the shortened text.\n"
    "Target: approximately {TARGET} tokens."
)

STRATEGIES = ["ocr", "dom-cleanup", "json-collapse", "truncate", "auto", "passthrough"]
CONTENT_TYPES = ["image", "dom-snapshot", "large-json", "large-text", "small-text"]

# JavaScript's whitespace set (what String.trim and \s strip), written for Java and RE2.
JS_WS = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


@dataclass(frozen=True)
class Rule:
    strategy: str
    tool_name: str | None = None
    tool_name_pattern: str | None = None


DEFAULT_RULES = (
    Rule("dom-cleanup", tool_name="browser_snapshot"),
    Rule("dom-cleanup", tool_name="puppeteer_snapshot"),
    Rule("auto", tool_name_pattern=".*"),
)


@dataclass(frozen=True)
class Config:
    image_ocr: bool = True
    json_collapse: bool = True
    text_threshold: int = DEFAULT_TEXT_THRESHOLD
    compression_prompt: str = DEFAULT_COMPRESSION_PROMPT
    dry_run: bool = False
    # Reduce results of tools of connected servers only; results of built-in tools stay as they are.
    server_tools_only: bool = True
    rules: tuple = field(default=DEFAULT_RULES)
    # Reduction sizes; defaults are the reference constants, fixtures pass smaller ones.
    head_tokens: int = HEAD_TOKENS
    tail_tokens: int = TAIL_TOKENS
    chunk_target: int = CHUNK_TARGET_TOKENS
    chunk_overlap: int = CHUNK_OVERLAP_TOKENS
    min_middle_target: int = MIN_MIDDLE_TARGET

    def with_(self, **kw) -> "Config":
        return replace(self, **kw)


# Sizes used on the driver's tables, whose texts are far below the defaults.
FIXTURE_CONFIG = Config(text_threshold=1_000, head_tokens=200, tail_tokens=100,
                        chunk_target=64, chunk_overlap=8)


def rules_from_json(items: list[dict]) -> tuple:
    return tuple(
        Rule(r["strategy"], tool_name=r.get("toolName"), tool_name_pattern=r.get("toolNamePattern"))
        for r in items
    )


def load_config(text: str | None, base: Config = Config()) -> Config:
    """Shallow overlay of a user JSON document on the defaults.

    Unreadable input gives the defaults; ``threshold`` then ``minBlockTokens`` feed the
    text threshold when ``textCompressionThreshold`` is absent; ``rules`` replace the
    default list as a whole.
    """
    if text is None:
        return base
    try:
        user = json.loads(text)
        if not isinstance(user, dict):
            return base
    except ValueError:
        return base
    kw = {}
    # Legacy keys: ``threshold`` is looked at first, then ``minBlockTokens``.
    for key in ("textCompressionThreshold", "threshold", "minBlockTokens"):
        if key in user:
            kw["text_threshold"] = int(user[key])
            break
    if "imageOcr" in user:
        kw["image_ocr"] = bool(user["imageOcr"])
    if "jsonCollapse" in user:
        kw["json_collapse"] = bool(user["jsonCollapse"])
    if "dryRun" in user:
        kw["dry_run"] = bool(user["dryRun"])
    if "compressionPrompt" in user:
        kw["compression_prompt"] = str(user["compressionPrompt"])
    if "rules" in user:
        kw["rules"] = rules_from_json(user["rules"])
    return replace(base, **kw)
