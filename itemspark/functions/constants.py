"""Fixed values. They must equal the published ones for results to match; do not tidy them."""

from __future__ import annotations

# Review intervals in days per box.
BOX_INTERVAL_DAYS = {1: 0, 2: 1, 3: 3, 4: 7, 5: 14}
MAX_BOX = 5

# Readiness.
PASS_MARK = 700
TARGET_SCORE = 0.75
GREEN_FROM = 0.75
AMBER_FROM = 0.55
COVERAGE_FLOOR = 0.6
COVERAGE_SPAN = 0.4
ROLLING_WINDOW = 50

# Classification.
MIN_MARGIN = 2
MIN_SCORE = 3

# Reconciliation and quality.
MIN_BACKGROUND_CHARS = 200
BACKGROUND_KEY_CHARS = 200
DISAGREEMENT_ALARM = 0.05
REVIEW_CHARS = 400

# Media.
MIN_IMAGE_BYTES = 5 * 1024
MAX_BLANK_BYTES_PER_PIXEL = 0.02

# Timing.
MS_PER_QUESTION = 120_000
RISK_MS = 240_000
MAX_CARD_MS = 600_000

# Digest caps.
CHARS_PER_LINE = 48
LINES_PER_SIDE = 30
SIDES_BUDGET = 3
TRUNCATION_MARK = "[…]"
CUE_MAX = 76
ANSWER_MAX = 96
WHY_MAX = 88
BOX_MAX = 30

# Six weighted areas: key, label, published band, weight (band midpoint / 0.95).
AREAS = (
    ("technical-design", "Create a technical design", 10, 15, 5 / 38),
    ("build-solutions", "Build Power Platform solutions", 10, 15, 5 / 38),
    ("apps-improvements", "Implement Power Apps improvements", 10, 15, 5 / 38),
    ("extend-ux", "Extend the user experience", 10, 15, 5 / 38),
    ("extend-platform", "Extend the platform", 30, 35, 13 / 38),
    ("integrations", "Develop integrations", 10, 15, 5 / 38),
)

# Legacy terms: pattern (case-sensitive), note.
LEGACY_TERMS = (
    (r"Common Data Service", "References Common Data Service; terminology superseded by Dataverse."),
    (r"\bCDS\b", "References CDS; terminology superseded by Dataverse."),
    (r"PowerApps portals", "References PowerApps portals; superseded by Power Pages."),
    (r"docs\.microsoft\.com", "Links to docs.microsoft.com; content has moved to learn.microsoft.com."),
    (r"Xrm\.Page", "Uses the deprecated Xrm.Page API; replaced by the execution context form API."),
    (r"\bUnified Service Desk\b", "Topic absent from the March 2026 blueprint."),
)

# Exam scaffolding removed before a cue is chosen (case-insensitive).
BOILERPLATE = (
    r"NOTE:.*",
    r"To answer,.*",
    r"Each correct (selection|answer presents).*",
    r"More than one answer choice may achieve the goal.*",
    r"Select the best answer\.?",
    r"Select and place\.?",
)

# Markers of the raw text.
MARKER = r"^\s*Question:\s*(\d+)"
MARKER_INLINE = r"Question:\s*(\d+)"
OPTION = r"^\s*([A-F])\.\s*(\S.*)$"
ANSWER_KEY = r"^[ \t]*Answer:[ \t]*(?:\r?\n[ \t]*)?([A-H](?:[ \t,]*[A-H])*)[ \t]*(?=\r?\n|$)"
ANSWER_LINE = r"^[ \t]*Answer:"
EXPLANATION = r"^[ \t]*Explanation:[ \t]*$"
REFERENCE = r"^[ \t]*Reference[s]?:[ \t]*$"
TYPE_MARKER = r"^[ \t]*(HOTSPOT|DRAG DROP)\b[ \t]*-?[ \t]*"
DECLARED_WORDS = ("HOTSPOT", "DRAG DROP")
BOX = r"Box\s*(\d+)\s*:\s*(.+?)(?=\s*(?:Box\s*\d+\s*:|$))"
URL = r"https?://[^\s)>\]]+"
SHARED_BACKGROUND = r"This is a case study\."
BACKGROUND_BOILERPLATE = r"This is a case study\..*?(?=\n\s*\n)"
BACKGROUND_HEADING = r"^[ \t]*Case study[ \t]*\r?\n?[ \t]*-?[ \t]*"

# Vocabulary.
CHOICE_TYPES = ("mcq-single", "mcq-multi")
VISUAL_TYPES = ("hotspot", "dragdrop")

# Code-language hints.
XML_HINT = r"</[A-Za-z]|/>|<\?xml"
CSHARP_HINT = (
    r"\b(using\s+System|namespace\s+[A-Za-z]|public\s+(sealed\s+|partial\s+|static\s+)?class|IPlugin"
    r"|IOrganizationService|ITracingService|IServiceProvider|EntityReference|QueryExpression)\b"
)
