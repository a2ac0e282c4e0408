"""Controlled vocabularies, key words, thresholds and scores. They must equal those of the data they meet."""

# White space and line ends as Unicode-aware text tools see them.
SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
# The same characters, one by one.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
LINE_ENDS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"  # beside \n, and \r\n as one
LINE_END = r"\x0D\x0A|[\x0A-\x0D\x1C-\x1E\x{85}\x{2028}\x{2029}]"
WORD_CHARS = r"[\p{L}\p{N}_]"

HORIZONTAL = ("CONTRASTS_WITH", "ALTERNATIVE_TO", "SIBLING_OF", "SIMILAR_TO")
STRUCTURAL = ("PART_OF", "ENABLES", "EXTENDS", "APPLIES_TO")
KU_TYPES = ("definition", "mechanism", "failure_mode", "trade_off", "procedure", "application")
BLOOM = ("remember", "understand", "apply", "analyze", "evaluate", "create")
DIFFICULTY = ("easy", "medium", "hard")
ANSWERS = ("A", "B", "C", "D")
MCQ_FIELDS = ("question", "A", "B", "C", "D", "answer", "explanation", "bloom_level", "difficulty", "source_chunk")
BLOOM_BY_DIFFICULTY = {"easy": ("remember", "understand"), "medium": ("apply", "analyze"), "hard": ("evaluate", "create")}

SUPPORTED = {
    ".pdf": "PDF", ".pptx": "PowerPoint", ".docx": "Word", ".xlsx": "Excel", ".xls": "Excel", ".jpg": "Image", ".jpeg": "Image",
    ".png": "Image", ".gif": "Image", ".bmp": "Image", ".webp": "Image",
}

STRUCTURAL_TOPICS = (
    "q&a", "conclusion", "learning objectives", "learning outcomes", "agenda", "table of contents", "references",
    "bibliography", "acknowledgement", "thank you", "introduction", "mục tiêu học", "kết luận", "tài liệu tham khảo",
    "câu hỏi", "ôn tập",
)
INSTRUCTIONAL_TOPICS = (
    "hands-on", "hands on", "exercise", "practice", "lab", "assignment", "workshop", "tutorial", "demo", "demonstration",
    "tools to explore", "best practice", "recommended resources", "further reading", "learning resources",
    "further resources", "thực hành", "bài tập",
)
RECAP_LABELS = ("conclusion", "summary", "recap", "review", "tong ket", "ket luan", "q&a")
SKIP_LABELS = (
    "hands-on", "hands on", "lab", "exercise", "thuc hanh", "thực hành", "practice", "card sort", "group activity", "bai tap",
    "bài tập", "references", "bibliography", "appendix", "citation", "thi nghiem", "thí nghiệm", "thông tin môn", "course info",
    "syllabus", "ký hiệu toán", "mathematical notation", "notation", "tài liệu tham khảo",
)

# Chunking
MIN_CHUNK_CHARS, MAX_PAGES, OVERLAP, DUPLICATE, WEAK_IMAGE_CHARS, WHOLE_DOC_CHARS = 150, 6, 0.12, 0.95, 200, 60_000
LONG_CHUNK_CHARS = 3000

# Ranking of distractors: source to (base score, rank)
DISTRACTOR_SOURCES = {
    "explicit_horizontal": (108, 0),
    "same_owner_same_type": (82, 1),
    "same_l1_same_type": (72, 2),
    "same_l1_related_type": (54, 3),
    "global_same_type": (44, 4),
    "structural_only_edge": (32, 5),
}
TYPE_GROUPS = (("definition", "mechanism"), ("mechanism", "procedure", "application"), ("failure_mode", "trade_off"))
HUB_DEGREE = 4
EDGE_CAP = {"CONTRASTS_WITH": 2, "ALTERNATIVE_TO": 2, "SIMILAR_TO": 1}
EDGE_PRIORITY = {"CONTRASTS_WITH": 1, "ALTERNATIVE_TO": 1, "EXTENDS": 2, "APPLIES_TO": 2, "ENABLES": 2, "SIMILAR_TO": 3, "SIBLING_OF": 5}
BLOOM_OF_TYPE = {
    "definition": "understand", "mechanism": "understand", "failure_mode": "analyze", "trade_off": "evaluate",
    "procedure": "apply", "application": "apply",
}
BLOOM_OF_RELATION = {
    "CONTRASTS_WITH": "evaluate", "ALTERNATIVE_TO": "evaluate", "SIMILAR_TO": "analyze", "SIBLING_OF": "analyze",
    "ENABLES": "understand", "EXTENDS": "analyze", "APPLIES_TO": "apply",
}
CROSS_THRESHOLD = {
    "CONTRASTS_WITH": 35, "ALTERNATIVE_TO": 35, "SIMILAR_TO": 50, "SIBLING_OF": 50, "ENABLES": 35, "EXTENDS": 35, "APPLIES_TO": 35,
}
CROSS_THRESHOLD_ELSE = 50
# Replacements in explanations, in the order in which they are applied, whatever the case.
EXPLANATION_WORDS = (
    ("phương án gây nhiễu", "lựa chọn chưa đúng"),
    ("đáp án gây nhiễu", "lựa chọn chưa đúng"),
    ("các phương án gây nhiễu", "các lựa chọn chưa đúng"),
    ("gây nhiễu", "chưa đúng"),
    ("distractor", "lựa chọn chưa đúng"),
    ("distractors", "các lựa chọn chưa đúng"),
    ("wrong answer candidate", "lựa chọn chưa đúng"),
    ("wrong answer candidates", "các lựa chọn chưa đúng"),
    ("nội dung nguồn", "kiến thức cần nắm"),
    ("bằng chứng nguồn", "thông tin đã cho"),
    ("source evidence", "thông tin đã cho"),
    ("source content", "nội dung bài học"),
    ("the source", "bài học"),
    ("nguồn", "bài học"),
    ("KU", "khái niệm"),
    ("Knowledge Unit", "khái niệm"),
)
