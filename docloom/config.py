"""Parameters of the engine, with their defaults. Fixed values that results depend on are given plainly."""

from __future__ import annotations

from dataclasses import dataclass, field

NOT_FOUND = "NOT_FOUND"

#: Header patterns by field, in the order in which a header tries them (fixed values).
HEADER_PATTERNS = (
    ("item_name", r"(item|description|name|particular|component|material|s\.?\s*no|sr\.?\s*no)"),
    ("specification_text", r"(specif|requirement|standard|detail|param|characteristic)"),
    ("unit", r"(unit|uom|measure)"),
    ("numeric_value", r"(value|quantity|qty|amount|number|numeric|vol|rate)"),
    ("tolerance", r"(tolerance|variation|range|limit)"),
    ("standard_reference", r"(standard|code|reference|is[\s:]|astm|iso|bis)"),
    ("material", r"(material|grade|type|class)"),
)
#: Words that let a table on an early page pass (fixed values).
TABLE_KEYWORDS = ("specification", "technical", "parameter", "requirement", "material", "grade", "tolerance", "standard")
#: Patterns, term lists and synonyms by which text is read (fixed values).
SECTION_PATTERN = r"^(\d+(?:\.\d+)*\.?)\s+(.+)$"
BULLET_PATTERN = r"^\s*[-•*]\s"
SPEC_SECTION_TERMS = ("specification", "technical", "parameter", "requirement", "compliance", "material", "performance")
SCOPE_SECTION_TERMS = ("scope", "work", "deliverable", "timeline", "schedule", "responsibil", "obligation", "exclusion")
SPEC_TEXT_PATTERN = r"\b(astm|iso|bis|is\s*[:\-]|minimum|maximum|tolerance|voltage|current|capacity|size|diameter|temperature|pressure|grade)\b"
SCOPE_TEXT_PATTERN = r"\b(shall|must|deliver|supply|install|commission|timeline|schedule|exclude|location|site|responsib)\w*\b"
SYNONYMS = (("specification", ("specs", "standard")), ("material", ("grade", "alloy")), ("dimension", ("size", "diameter")))
TOPIC_PATTERNS = (
    r"(?:procurement|supply|purchase|tender for)[^\n]{0,200}",
    r"(?:name of work|subject)[:\s]+([^\n]{10,150})",
    r"CHAPTER[\s\-]+\d+[^\n]*\n([^\n]{20,200})",
)
#: Retrieval queries made from a topic; {topic} stands for it (fixed values).
SPEC_QUERIES = (
    "{topic}",
    "Find sections related to: Scope of Work, Technical Specifications, Equipment Specifications, System Requirements, Annexures containing technical data",
    "{topic} scope of work work description project scope deliverables",
    "{topic} technical specifications technical requirements system requirements",
    "{topic} equipment specifications annexure specifications parameter value unit",
    "scope work technical specifications requirements equipment system annexure",
    "schedule of requirements technical details features parameter value unit tolerance",
    "minimum maximum operating parameters compliance standard IS ASTM",
)
SCOPE_QUERIES = (
    "detailed scope of work tasks deliverables",
    "project completion schedule milestones timeline",
    "items excluded from scope boundary limits",
    "technical requirements and contractor obligations",
)
#: What the default embedding model wants before a question (a fixed value).
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "
FILE_SUFFIXES = (".pdf", ".docx", ".jpg", ".jpeg", ".png")


@dataclass(frozen=True)
class Config:
    scanned_chars: int = 50
    heading_size: float = 12.0
    heading_length: int = 150
    max_tokens: int = 500
    overlap_tokens: int = 100
    semantic_factor: float = 1.5
    child_words: int = 200
    child_stride: int = 150
    k1: float = 1.5
    b: float = 0.75
    epsilon: float = 0.25
    bm25_weight: float = 0.35
    dense_weight: float = 0.65
    candidates: int = 5
    table_boost: float = 1.15
    spec_section_boost: float = 1.15
    spec_text_boost: float = 1.10
    scope_type_boost: float = 1.10
    scope_section_boost: float = 1.20
    scope_text_boost: float = 1.10
    context_tokens: int = 4096 - 512 - 750
    near_copy_ratio: float = 80.0
    near_copy_chars: int = 200
    high: float = 0.90
    medium: float = 0.60
    reject: float = 0.40
    keyword_page: int = 15
    spec_page: int = 20
    max_bytes: int = 50 * 1024 * 1024
    suffixes: tuple[str, ...] = field(default=FILE_SUFFIXES)


DEFAULT = Config()
