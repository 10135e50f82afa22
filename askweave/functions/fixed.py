"""Word lists, patterns and numbers whose exact content decides results.

Nothing in this module is logic.  Everything is stated as plain text so that it
can be compared, reviewed and replaced for another language.
"""

# --- fixed values: lexical analysis -----------------------------------------

STOPWORDS = [
    "ai", "anh", "ay", "ban", "bang", "bao", "bi", "cac", "cai", "can", "chi",
    "cho", "co", "con", "cua", "da", "dang", "day", "de", "den", "di", "do",
    "duoc", "duoi", "gi", "giua", "hay", "hon", "khi", "khong", "la", "lai",
    "lam", "may", "mot", "nao", "nay", "neu", "ngay", "nhieu", "nhu", "nhung",
    "o", "phai", "qua", "ra", "rang", "sau", "se", "so", "tai", "the", "thi",
    "theo", "tren", "trong", "truoc", "tu", "va", "vao", "ve", "vi", "voi",
]
DATE_TOKENS = ["ngay", "thang", "nam"]

GRAM_STOPWORDS = [
    "và", "của", "là", "có", "được", "trong", "để", "các", "cho", "với",
    "này", "một", "những", "đã", "từ", "không", "cũng", "như", "về",
    "theo", "khi", "trên", "tại", "hay", "đến", "do", "bị", "vào",
    "ra", "lên", "mà", "nên", "nhưng", "còn", "hoặc", "thì", "rất",
    "sẽ", "đang", "bởi", "nếu", "vì", "hơn", "chỉ", "sau", "qua",
    "lại", "nhiều", "nào", "đó", "giữa", "dưới", "trước", "phải",
]

ABBREVIATIONS = ["tr", "tp", "gs", "ts", "ths", "bs", "vs", "vd", "st", "mr", "mrs", "ms", "dr", "prof", "v.v"]

# Old tone-mark placement -> new placement.  LEGACY_ACCENTS holds the two
# published entries that transpose letters instead of moving the mark.
ACCENT_PLACEMENT = [
    ("oà", "òa"), ("oá", "óa"), ("oả", "ỏa"), ("oã", "õa"), ("oạ", "ọa"),
    ("oè", "òe"), ("oé", "óe"), ("oẻ", "ỏe"), ("oẽ", "õe"), ("oẹ", "ọe"),
    ("uỳ", "ùy"), ("uý", "úy"), ("uỷ", "ủy"), ("uỹ", "ũy"), ("uỵ", "ụy"),
    ("Oà", "Òa"), ("Oá", "Óa"), ("Oả", "Ỏa"), ("Oã", "Õa"), ("Oạ", "Ọa"),
    ("Oè", "Òe"), ("Oé", "Óe"), ("Oẻ", "Ỏe"), ("Oẽ", "Õe"), ("Oẹ", "Ọe"),
    ("Uỳ", "Ùy"), ("Uý", "Úy"), ("Uỷ", "Ủy"), ("Uỹ", "Ũy"), ("Uỵ", "Ụy"),
]
LEGACY_ACCENTS = {"oẽ": "ẽo", "Oẽ": "Ẽo"}

# --- fixed values: chunking and retrieval -------------------------------------

CHUNK_MAX_TOKENS = 220
CHUNK_OVERLAP_SENTENCES = 2
BM25_K1, BM25_B = 1.5, 0.75
LUCENE_K1, LUCENE_B = 0.9, 0.4
OKAPI_EPSILON = 0.25
BM25_DELTA = {"l": 0.5, "plus": 1.0}
RRF_K = 60
HASH_BUCKETS = 1 << 24
RECALL_KS = [1, 3, 5, 10, 20, 50]
GOLD_JACCARD = 0.8
RANKING_WEIGHTS = {"retrieval": 0.30, "reader": 0.60, "answer_type": 0.10, "relation": 0.00}
CANDIDATES_MIN, CANDIDATES_MAX, CANDIDATES_FACTOR = 20, 40, 2
TOP_K_DEFAULT, TOP_K_MAX = 10, 20
PREFERRED_CAP = 0.92
RETRIEVERS = ["tfidf", "bm25", "hybrid", "dense"]
READERS = ["phobert", "xlmr", "llm", "llm_chat"]

# --- fixed values: evaluation ---------------------------------------------------

GRID_WEIGHTS = [
    ("A_R50_Reader30_Type20", 0.50, 0.30, 0.20, 0.0),
    ("B_R40_Reader40_Type20", 0.40, 0.40, 0.20, 0.0),
    ("C_R40_Reader30_Type20_Relation10", 0.40, 0.30, 0.20, 0.10),
    ("D_R35_Reader35_Type15_Relation15", 0.35, 0.35, 0.15, 0.15),
]
GRID_PENALTIES = [0.6, 0.8, 0.9, 1.0]
GRID_THRESHOLD_STEPS = (12, 36, 40)  # 12/40 .. 36/40
PRIORITY_F1, PRIORITY_NO_ANSWER = 0.7, 0.3
LOW_COVERAGE = 5
HOLDOUT_STRICT_BUCKETS = ["CAUSE", "TIME", "LOCATION", "PURPOSE", "DEFINITION"]

# --- fixed values: feedback -------------------------------------------------------

FEEDBACK_TYPES = [
    "CORRECT", "INCORRECT", "SPAN_CORRECTION", "NO_ANSWER_BUT_SHOULD_HAVE",
    "ANSWERED_BUT_SHOULD_NOT", "DOCUMENT_SUBMISSION",
]
FEEDBACK_STATUSES = ["PENDING", "REVIEWED", "APPROVED", "REJECTED"]
REVIEW_DECISIONS = ["REVIEWED", "APPROVED", "REJECTED"]
DOCUMENT_STATUSES = ["PENDING_REVIEW", "APPROVED", "REJECTED"]
DOCUMENT_SOURCE_TYPES = ["PLAIN_TEXT", "TXT"]
NO_ANSWER_COMPLAINTS = ["NO_ANSWER_BUT_SHOULD_HAVE", "ANSWERED_BUT_SHOULD_NOT"]
FINGERPRINT_SEPARATOR = "␟"
TOP_REASONS = 12

# --- fixed values: question patterns (applied to folded text) -----------------------

TYPE_PATTERNS = {
    "TIME": [
        r"\bkhi nao\b", r"\bbao gio\b", r"\b(?:nam|thang|ngay|the ky) nao\b",
        r"\btu (?:nam|thang|ngay|the ky) nao\b", r"\bvao (?:nam|thang|ngay|the ky) nao\b",
        r"\bthoi gian nao\b", r"\bsinh(?: vao)? nam bao nhieu\b", r"\bnam sinh cua\b.+\bbao nhieu\b",
    ],
    "PERSON": [r"\bai\b", r"\bnguoi nao\b", r"\bnhan vat nao\b"],
    "LOCATION": [
        r"\bo dau\b", r"\btai dau\b", r"\bnoi nao\b", r"\bdia diem nao\b", r"\bdia danh nao\b",
        r"\bkhu vuc nao\b", r"\b(?:con )?song nao\b", r"\b(?:thanh pho|tinh|quoc gia|nuoc) nao\b",
    ],
    "DEFINITION": [
        r"\bla gi\b", r"\bco nghia la gi\b", r"\bdinh nghia\b", r"\bduoc hieu nhu the nao\b",
    ],
}
CAUSE_TYPE_PATTERN = (
    r"\b(?:vi sao|tai sao|do dau|boi dau)\b|\b(?:nguyen nhan|ly do)\b|"
    r"\b(?:dieu gi|yeu to nao) (?:khien|lam)\b|\bvi nguyen nhan gi\b"
)
COARSE_RELATIONS = [
    ("CONTRAST", r"\b(?:khac nhau|su khac biet|khac biet giua|so voi)\b"),
    ("CAUSE", r"\b(?:tai sao|vi sao|do dau|boi dau|do nguyen nhan nao|nguyen nhan|ly do|"
              r"dieu gi (?:khien|lam)|yeu to nao (?:khien|lam)|vi nguyen nhan gi)\b"),
    ("PURPOSE", r"\b(?:de lam gi|nham muc dich|muc dich gi|voi muc dich gi)\b"),
    ("METHOD", r"\b(?:bang cach nao|theo cach nao|phuong phap nao)\b"),
    ("ATTRIBUTE", r"\b(?:tinh chat|dac diem|tinh hinh|trang thai|vai tro|vi the)\b"),
    ("DEFINITION", r"\b(?:la gi|la ai)\b"),
]
WEAK_BUCKETS = [
    ("CAUSE", r"\b(?:vi sao|tai sao|do dau|boi dau|nguyen nhan|ly do)\b"),
    ("CAUSE", r"\b(?:dieu gi|yeu to nao)\b.+\b(?:khien|lam|dan toi|dan den)\b"),
    ("PURPOSE", r"\b(?:muc dich|de lam gi|nham|nham vao|nham muc tieu)\b"),
    ("TIME", r"\b(?:khi nao|bao gio|nam nao|ngay nao|thang nao|thoi gian nao|"
             r"nam bao nhieu|nam sinh|sinh nam|sinh vao nam|the ky nao)\b"),
    ("LOCATION", r"\b(?:o dau|tai dau|noi nao|dia diem nao|dia danh nao|khu vuc nao|"
                 r"thanh pho nao|tinh nao|quoc gia nao|nuoc nao)\b"),
    ("DEFINITION", r"\b(?:la gi|co nghia la gi|dinh nghia|duoc hieu nhu the nao)\b"),
    ("ENTITY", r"\b(?:ai|nguoi nao|nhan vat nao|cai gi|dieu gi|cong trinh nao|"
               r"tac pham nao|to chuc nao|ten goi nao|bi danh nao|ten nao|loai nao)\b"),
]
# Surface (unfolded, lower-cased) classes of the exploratory report.  The label
# is bound to the word list; the boundary is added by the caller.
QUESTION_CLASSES = [
    ("Ai (Who)", "ai|nhân vật|tác giả|ông|bà"),
    ("Khi nào (When)", "khi nào|năm nào|thời gian|ngày nào|tháng nào|vào năm"),
    ("Ở đâu (Where)", "ở đâu|tại đâu|nơi nào|địa danh|đâu"),
    ("Bao nhiêu (Count)", "bao nhiêu|mấy|số lượng"),
    ("Tại sao (Why)", "tại sao|vì sao|lý do"),
    ("Thế nào (How)", "như thế nào|thế nào|cách nào"),
]
QUESTION_CLASS_OTHER = "Cái gì / Khác (What/Other)"

# Cause questions: the named group of each pattern is the effect being asked about.
CAUSE_BODY_PATTERNS = [
    r"^(?:vi sao|tai sao|vi dau|do dau|boi dau)\s+(.+?)\s*[?!.]*$",
    r"^(?:do nguyen nhan nao|nguyen nhan(?:\s+[\w]+){0,3}?\s+nao|nguyen nhan gi|ly do gi|ly do nao|"
    r"vi nguyen nhan gi)\s+(?:(?:khien|lam)\s+)?(.+?)\s*[?!.]*$",
    r"^(?:dieu gi|yeu to nao)\s+(?:khien|lam)\s+(.+?)\s*[?!.]*$",
    r"^dieu gi\s+(?:dan toi|gay ra)\s+(?:viec\s+)?(.+?)\s*[?!.]*$",
    r"^(.+?)\s+(?:vi sao|tai sao|vi ly do gi|do nguyen nhan gi|vi nguyen nhan gi)\s*[?!.]*$",
]
CAUSE_TARGET_PATTERNS = [
    r"^(?:vi sao|tai sao|do dau|boi dau)\s+(.+?)\s*[?!.]*$",
    r"^(?:do nguyen nhan nao|nguyen nhan gi|nguyen nhan nao|ly do gi|ly do nao|"
    r"vi nguyen nhan gi)\s+(?:khien\s+)?(.+?)\s*[?!.]*$",
    r"^(?:dieu gi|yeu to nao)\s+khien\s+(.+?)\s*[?!.]*$",
    r"^nguyen nhan(?:\s+[\w]+){0,3}?\s+nao\s+(?:khien|tao nen|gay ra|dan den|lam cho)\s+(.+?)\s*[?!.]*$",
    r"^dau\s+duoc\s+xem\s+la\s+nguyen\s+nhan.+?\s+(?:cho|cua)\s+(.+?)\s*[?!.]*$",
    r"^(.+?)\s+(?:vi\s+ly\s+do\s+gi|do\s+nguyen\s+nhan\s+gi|vi\s+nguyen\s+nhan\s+gi)\s*[?!.]*$",
    r"^(.+?)\s+(?:vi sao|tai sao)\s*[?!.]*$",
]
CAUSE_PREDICATE = (
    r"\b(?:phat trien manh|phat trien|bi|duoc|da|dang|se|phai|co|la|tro thanh|"
    r"sinh|ra doi|dien ra|xay ra|roi|mat|khien|lam)\b"
)

# (rule id, category, relation, description, pattern)
RULES = [
    ("CAUSE_MARKER_PREFIX", "question_relation", "CAUSE", CAUSE_BODY_PATTERNS[0]),
    ("CAUSE_NOMINAL_PREFIX", "question_relation", "CAUSE", CAUSE_BODY_PATTERNS[1]),
    ("CAUSE_TRIGGER_PREFIX", "question_relation", "CAUSE", CAUSE_BODY_PATTERNS[2] + "|" + CAUSE_BODY_PATTERNS[3]),
    ("CAUSE_MARKER_SUFFIX", "question_relation", "CAUSE", CAUSE_BODY_PATTERNS[4]),
    ("TIME_BIRTH_MARKER", "question_relation", "TIME", r"\b(?:nam sinh cua|ngay sinh cua|sinh(?: ra)?(?: vao)? nam|chao doi)\b"),
    ("TIME_DEATH_MARKER", "question_relation", "TIME", r"\b(?:mat|qua doi|tu tran)\b"),
    ("LOCATION_INTERROGATIVE", "question_relation", "LOCATION", r"\b(?:o dau|tai dau|noi nao|dia diem nao)\b"),
    ("PURPOSE_INTERROGATIVE", "question_relation", "PURPOSE", r"\b(?:voi|nham)?\s*(?:muc dich|muc tieu)\s+gi\b|\bde lam gi\b"),
    ("IDENTITY_INTERROGATIVE", "question_relation", "ENTITY", r"\b(?:ten goi|bi danh|ten khac|ten nao)\b"),
    ("PREDICATE_AUXILIARY_BOUNDARY", "predicate_boundary", None, r"\b(?:bi|duoc|da|dang|se|tung|phai)\b"),
    ("PREDICATE_EVENT_BOUNDARY", "predicate_boundary", None, r"\b(?:sinh ra|sinh|chao doi|ra doi|mat|qua doi|dien ra|xay ra|no ra|moc ra|moc|xuat hien|phan bo|"
     r"duoc trong|duoc tim thay|toa lac|nam|gui|phat trien|gia tang|suy giam|bung no|sup do|"
     r"tro thanh|thanh lap|xay dung)\b"),
    ("PREDICATE_COPULA_BOUNDARY", "predicate_boundary", None, r"\b(?:co|la)\b"),
    ("PREDICATE_MODIFIER_BOUNDARY", "predicate_modifier", None, r"\s+\b(?:tai|o|tren|trong|vao|tu|den)\b\s+"),
]
TIME_BIRTH = r"\b(?:nam sinh|sinh(?: ra)?(?: vao)? nam|sinh nam|ra doi|chao doi)\b"
TIME_DEATH = r"\b(?:mat|qua doi|tu tran)\b"
LOCATION_RELATIONS = [
    ("PROCESS_LOCATION",
     r"\b(?:sinh ra|moc(?: ra)?|phat trien|xuat hien|phan bo|duoc trong|duoc tim thay)\b"),
    ("BIRTH_LOCATION", r"\b(?:sinh(?=\s+(?:o|tai))|chao doi|ra doi)\b"),
    ("DEATH_LOCATION", r"\b(?:mat|qua doi|tu tran)\b"),
    ("EVENT_LOCATION", r"\b(?:dien ra|xay ra|no ra|to chuc)\b"),
    ("OBJECT_LOCATION", r"\b(?:nam|toa lac|dat|thuoc|sinh song|cu tru)\b"),
]
NOMINAL_TIME_SUBJECT = (
    r"^(?:nam sinh|ngay sinh)\s+cua\s+(.+?)\s+la\s+(?:bao nhieu|gi|ngay nao|nam nao)"
)
DEFINITION_SUBJECT = r"^(.+?)\s+(?:la ai|la gi)\s*[?!.]*$"
_PLACE_TAIL = r"\s+(?:o dau|tai dau|noi nao|dia diem nao)\s*[?!.]*$"
INTERROGATIVE_TAILS = {
    "BIRTH_TIME": [r"\s+(?:vao\s+)?nam\s+(?:nao|bao nhieu)\s*[?!.]*$", r"\s+bao\s+nhieu\s*[?!.]*$"],
    "DEATH_TIME": [r"\s+(?:vao\s+)?nam\s+(?:nao|bao nhieu)\s*[?!.]*$"],
    "EVENT_TIME": [r"\s+(?:khi nao|bao gio|vao nam nao|nam nao)\s*[?!.]*$"],
    "PURPOSE": [r"\s+(?:voi muc dich gi|nham muc dich gi|nham muc tieu gi|de lam gi)\s*[?!.]*$"],
    "EVENT_LOCATION": [_PLACE_TAIL],
    "OBJECT_LOCATION": [_PLACE_TAIL, r"\s+nam\s+ben\s+bo\s+(?:con\s+)?song\s+nao\s*[?!.]*$"],
    "PROCESS_LOCATION": [r"\s+(?:o dau|tai dau|noi nao|dia diem nao|vi tri nao)\s*[?!.]*$"],
}

# --- fixed values: answer assessment --------------------------------------------------

_ROMAN = "(?:xxi|xx|xix|xviii|xvii|xvi|xv|xiv|xiii|xii|xi|ix|viii|vii|vi|iv|iii|ii|i)"
_ORDINAL = (
    r"(?:mot|hai|ba|bon|tu|nam|sau|bay|tam|chin|muoi"
    r"|muoi\s+(?:mot|hai|ba|bon|tu|nam|sau|bay|tam|chin)|hai\s+muoi(?:\s+mot)?)"
)
TIME_ANSWER_PATTERN = "|".join([
    rf"\bthe ky\s+(?:thu\s+)?(?:\d{{1,2}}|{_ROMAN}|{_ORDINAL})\b",
    r"\b(?:nam|tu nam|vao nam)\s+(?:1\d{3}|20\d{2})\b",
    r"\b(?:1\d{3}|20\d{2})\s*(?:-|–|den|toi)\s*(?:1\d{3}|20\d{2})\b",
    r"\bngay\s+\d{1,2}(?:\s+thang\s+\d{1,2})?(?:\s+nam\s+\d{3,4})?\b",
    r"\bthang\s+\d{1,2}(?:\s+nam\s+\d{3,4})?\b",
    r"\b(?:dau|giua|cuoi)\s+(?:nhung\s+nam|the ky|thap nien)\b",
    r"\b(?:thoi ky|giai doan|thap nien)\b",
])
YEAR_PATTERN = r"\b(?:1\d{3}|20\d{2})\b"
LOCATION_TERMS = [
    "thanh pho", "tinh", "huyen", "xa", "quan", "quoc gia", "nuoc", "dao", "chau", "mien",
    "khu vuc", "thu do", "lanh tho", "thi tran", "phuong",
]
LOCATION_EVENT_TERMS = [
    "cach mang", "chien tranh", "cuoc chien", "tran", "phong trao", "khoi nghia", "hoi nghi",
    "hiep dinh", "le hoi", "su kien",
]
LOCATION_ORGANIZATION_TERMS = [
    "dai hoc", "truong dai hoc", "cong ty", "tap doan", "to chuc", "hoc vien", "benh vien",
    "vien nghien cuu",
]
PERSON_TERMS = [
    "ong", "ba", "vua", "nu hoang", "tong thong", "thu tuong", "giao su", "tac gia", "nha van",
    "nha tho", "nhac si", "tuong", "bac si",
]
NUMBER_WORDS = [
    "khong", "mot", "hai", "ba", "bon", "tu", "nam", "sau", "bay", "tam", "chin", "muoi",
    "tram", "nghin", "trieu", "ty",
]
ENTITY_DESIGNATORS = [
    "bao tang", "benh vien", "cau", "chua", "cong ty", "cong trinh", "cung dien", "den",
    "dia danh", "hoc vien", "lau dai", "nha hat", "nha may", "nha tho", "nui", "quan",
    "san van dong", "song", "tac pham", "tap doan", "thanh pho", "thap", "thu vien", "tinh",
    "to chuc", "truong", "vuong cung thanh duong",
]
CLAUSE_VERBS = ["co", "da", "dang", "duoc", "gom", "la", "lam", "mang", "nam", "tro thanh"]
LEADING_CONNECTORS = ["là", "và", "của", "thì", "mà"]
TRAILING_CONNECTORS = ["là", "và", "của", "về", "khi", "tại", "ở", "trong", "đến", "từ"]
DANGLING_CONNECTORS = [
    "trong khi", "hoac", "nhung", "rang", "hay", "va", "ma", "vi", "do", "boi", "nen", "neu",
    "khi", "con",
]
RIGHT_STOP = r"[.;!?]|\s+va\s+vi\s+the\b|\s+vi\s+the\b|\s+do\s+do\b|\s+nen\b|\s+khien\b|\s+dan\s+den\b"
DANGLING_EXPANSION_CHARS = 120
RELATION_TRAILING = ["va", "cua", "ve", "tu", "den", "trong", "do", "tai"]
ANAPHORIC_CAUSE = r"^(?:vi )?(?:dieu nay|viec nay|su viec nay|nguyen nhan nay|ly do tren|do do)$"
INCOMPLETE_CAUSE_NOUNS = ["xuat than", "anh huong", "tac dong", "nguyen nhan"]
LEFT_DESIGNATORS = [
    "vương cung thánh đường", "nhà thờ", "thành phố", "thủ đô", "tỉnh", "quận", "huyện", "xã",
    "đảo", "núi", "sông", "cầu", "bảo tàng", "công ty", "tổ chức", "trường đại học", "đại học",
    "Thiếu tướng", "Trung tướng", "Đại tướng", "Tổng thống", "Thủ tướng", "Chủ tịch", "Giáo sư",
    "Tiến sĩ",
]
RELATIVE_CLAUSE = r",\s*(?:được|đã|đang|sẽ|vốn|nơi|mà|do|khi|trong[\s_]+khi)\b"
FACTOID_SCAFFOLD = r"^(?:[,;:]\s*)?(?:(?:là|chính[\s_]+là)[\s_:,-]+)"
COREFERENCE = r"\b(?:ong|ba|nguoi nay|nhan vat nay|nha van nay|triet gia nay|vi nay)\b"
SUBJECT_STOPWORDS = ["cac", "cua", "mot", "nhung", "tai", "the", "trong", "va", "vao", "ve"]
ANSWER_CUES = [
    "duoc chia thanh", "duoc chia lam", "chia thanh", "chia lam", "bao gom", "gom", "la",
    "duoc goi la", "co nghia la", "duoc dinh nghia",
]

# --- fixed values: gate policy ------------------------------------------------------------

GATE_ORDER = ["span", "boundary", "completeness", "evidence", "subject", "relation", "answer_type", "ranking"]
GATE_THRESHOLDS = {
    "boundary": 0.20, "answer_type": 0.50, "evidence": 0.50, "completeness": 0.50, "ranking": 0.60,
}
# (method, penalty, minimum answer-type score, failure reason)
METHOD_POLICIES = [
    ("neural_span", 1.0, 0.50, "ANSWER_TYPE_MISMATCH"),
    ("phrase_fallback", 1.0, 0.50, "ANSWER_TYPE_MISMATCH"),
    ("sentence_fallback", 0.60, 0.75, "INSUFFICIENT_FALLBACK_EVIDENCE"),
]
SENTENCE_MIN_GENERATION = 0.42
# (relation, subject required, relation required, min subject, min relation, ranking bypass)
RELATION_POLICIES = [
    ("GENERAL", False, False, 0.50, 0.50, False),
    ("GENERIC_LOCATION", False, False, 0.50, 0.50, False),
    ("CAUSE", True, True, 0.50, 0.50, True),
    ("BIRTH_TIME", True, True, 0.50, 0.90, True),
    ("DEATH_TIME", True, True, 0.50, 0.90, True),
    ("EVENT_TIME", False, False, 0.50, 0.50, True),
    ("EVENT_LOCATION", True, True, 0.50, 0.50, True),
    ("OBJECT_LOCATION", True, True, 0.50, 0.50, True),
    ("PROCESS_LOCATION", True, True, 0.50, 0.50, True),
    ("BIRTH_LOCATION", True, True, 0.50, 0.50, True),
    ("DEATH_LOCATION", True, True, 0.50, 0.50, True),
    ("PURPOSE", True, True, 0.50, 0.50, True),
    ("CONTRAST", False, True, 0.50, 0.50, True),
    ("DEFINITION", False, True, 0.50, 0.50, True),
    ("IDENTITY", False, True, 0.50, 0.50, True),
    ("ATTRIBUTE", False, False, 0.50, 0.50, False),
]
DEFAULT_POLICY = (True, True, 0.50, 0.50, False)
DEBUG_PRIORITY = [
    (6, ["LOW_RANKING_SCORE"]),
    (5, ["SPAN_BOUNDARY_INCOMPLETE", "INCOMPLETE_RELATION", "LOCATION_RELATION_MISMATCH",
         "RELATION_MISMATCH", "CAUSE_RELATION_MISMATCH", "CAUSE_TARGET_MISMATCH",
         "CAUSE_SUBJECT_MISMATCH", "CAUSE_PHRASE_NOT_FOUND", "CAUSE_RELATION_NOT_FOUND",
         "CAUSE_EFFECT_REPETITION", "TIME_SUBJECT_MISMATCH", "BIRTH_TIME_RELATION_MISMATCH",
         "DEATH_TIME_RELATION_MISMATCH", "PURPOSE_SUBJECT_MISMATCH", "PURPOSE_RELATION_NOT_FOUND",
         "DANGLING_CONNECTOR", "INCOMPLETE_CLAUSE"]),
    (4, ["ANSWER_TYPE_MISMATCH"]),
    (3, ["INSUFFICIENT_FALLBACK_EVIDENCE"]),
    (2, ["EVIDENCE_UNSUPPORTED"]),
    (1, ["NO_VALID_SPAN"]),
]

# --- fixed values: extraction patterns (applied to the original spelling) ----------------------

_UPPER = "A-ZÀÁẢÃẠĂẮẰẲẴẶÂẤẦẨẪẬĐÈÉẺẼẸÊẾỀỂỄỆÌÍỈĨỊÒÓỎÕỌÔỐỒỔỖỘƠỚỜỞỠỢÙÚỦŨỤƯỨỪỬỮỰỲÝỶỸỴ"
PROPER_NAME = rf"[{_UPPER}][\wÀ-ỹĐđ'’-]*(?:[\s_]+[{_UPPER}][\wÀ-ỹĐđ'’-]*){{0,5}}"
PERSON_TITLE = (
    r"(?:Thiếu[\s_]+tướng|Đại[\s_]+tướng|Trung[\s_]+tướng|Tổng[\s_]+thống|"
    r"Thủ[\s_]+tướng|Chủ[\s_]+tịch|Giáo[\s_]+sư|Tiến[\s_]+sĩ)"
)
CONTRAST_QUESTION = r"\b(?:khac biet|khac nhau|phan biet|so voi|so sanh)\b"
ALIAS_QUESTION = r"\b(?:ten goi|bi danh|ten khac|ten) nao\b"
ROLE_QUESTION = r"\b(?:chuc vu|vai tro|tu cach)\b"
DESCRIPTION_QUESTION = r"\b(?:nhu the nao|ra sao)\b"
PROPERTY_QUESTION = r"\b(?:tinh chat|dac diem|trang thai)\b"
SITUATION_QUESTION = r"\b(?:tinh hinh|dien bien|anh huong|tac dong|vai tro|vi the)\b"
CONTRAST_PATTERNS = [
    r"(?:sự[\s_]+)?khác[\s_]+biệt[\s_]+giữa[\s_]+.+?[\s_]+và[\s_]+.+?(?=[.;!?]|$)",
    r"[^.;!?]+?[\s_]+trong[\s_]+khi[\s_]+[^.;!?]+",
]
PURPOSE_PATTERN = (
    r"\b(?:để|nhằm|với[\s_]+mục[\s_]+đích(?:[\s_]+là)?)[\s_]+([^,.;!?]{2,180}?)(?=[,.;!?]|$)"
)
METHOD_PATTERN = r"\b(?:bằng[\s_]+cách|thông[\s_]+qua|nhờ)[\s_]+([^,.;!?]{2,180}?)(?=[,.;!?]|$)"
ALIAS_PATTERN = (
    r"\b(?:có[\s_]+)?(?:tên[\s_]+gọi|bí[\s_]+danh|tên[\s_]+khác)"
    rf"(?:[\s_]+(?:của|là))?[\s_:,-]+(?:là[\s_]+)?({PROPER_NAME})"
)
ROLE_PATTERN = (
    r"\b(?:được[\s_]+giao[\s_]+nhiệm[\s_]+vụ|giữ[\s_]+chức[\s_]+vụ|"
    r"đảm[\s_]+nhiệm(?:[\s_]+(?:chức[\s_]+vụ|vai[\s_]+trò))?|"
    r"với[\s_]+tư[\s_]+cách(?:[\s_]+là)?)[\s_:,-]+"
    r"([^,.;!?]{2,100}?)(?=[\s_]+(?:dự|tại|trong|khi|từ|đến)[\s_]+|[,.;!?]|$)"
)
PROPERTY_PATTERN = (
    r"\b((?:rất|vô[\s_]+cùng|cực[\s_]+kỳ|khá|tương[\s_]+đối|đặc[\s_]+biệt)[\s_]+[^,.;!?]{1,100}?)(?=[,.;!?]|$)"
)
TEMPORAL_PATTERNS = [
    r"\b(?:Năm|năm)[\s_]+\d{3,4}\b",
    r"\b(?:Tháng|tháng)[\s_]+\d{1,2}(?:[\s_]+(?:năm)[\s_]+\d{3,4})?\b",
    r"\b(?:Ngày|ngày)[\s_]+\d{1,2}(?:[\s_]+tháng[\s_]+\d{1,2})?(?:[\s_]+năm[\s_]+\d{3,4})?\b",
    r"(?i)\b(?:thế[\s_]+kỷ)[\s_]+(?:\d{1,2}|[IVX]{1,5})\b",
]
NUMBER_PATTERNS = [
    r"\b(?:hơn|gần|khoảng|trên|dưới)?[\s_]*\d+(?:[.,]\d+)?(?:[\s_]*%)?"
    r"(?:[\s_]+(?:người|con|lần|phần|nhóm|chiếc|km|mét|triệu|tỷ|nghìn))?\b",
    r"\b(?:không|một|hai|ba|bốn|tư|năm|sáu|bảy|tám|chín|mười)"
    r"(?:[\s_]+(?:người|đứa|người[\s_]+con))?[\s_]+(?:con|người|lần|phần|nhóm|chiếc|năm)\b",
]
PERSON_PATTERNS = [
    rf"\b(?:là|do)[\s_]+((?:{PERSON_TITLE}[\s_]+)?{PROPER_NAME})"
    r"(?=[\s_]+(?:lãnh[\s_]+đạo|đứng[\s_]+đầu)|[,.;!?]|$)",
    rf"\b({PERSON_TITLE}[\s_]+{PROPER_NAME})",
]
# (name, pattern, base score)
ENTITY_PATTERNS = [
    ("called_name", r"\b(?:được[\s_]+gọi[\s_]+là|được[\s_]+biết[\s_]+đến[\s_]+(?:như|là))\b", 0.82),
    ("typed_copula", r"\b(?:chính[\s_]+)?là[\s_]+(?:vị[\s_]+trí|nơi|tên[\s_]+của)\b", 0.84),
    ("location_or_membership", r"\b(?:tọa[\s_]+lạc[\s_]+tại|nằm[\s_]+tại|thuộc|bao[\s_]+gồm|gồm)\b", 0.80),
    ("plain_copula", r"\b(?:chính[\s_]+)?là\b", 0.68),
]
ENTITY_MINIMUM = 0.72
COMPARISON_PREFIX = r"\b(?:hon|kem|thay vi|khong phai|cung nhu|vi nhu)\s*$"
ENTITY_SCAFFOLD = r"^(?:(?:(?:là|chính[\s_]+là|vị[\s_]+trí|nơi|tên[\s_]+của)[\s_:,-]+)|(?:(?:một|các|những)[\s_]+))+"
ENTITY_TAIL = r",\s+(?:nơi|mà|vốn|được|đã|sẽ|từng|nhưng|còn|do|vì|khi|trong[\s_]+khi)\b"
# relation -> (pattern on folded question, pattern on original sentence)
PLACE_RELATIONS = [
    ("EVENT_LOCATION", r"(?:dien ra|xay ra|no ra)", r"(?:diễn[\s_]+ra|xảy[\s_]+ra|nổ[\s_]+ra)"),
    ("OBJECT_LOCATION", r"(?:nam|toa lac|dat|dong|thuoc)", r"(?:nằm|tọa[\s_]+lạc|đặt|đóng|thuộc)"),
    ("PROCESS_LOCATION", r"(?:sinh ra|moc(?: ra)?|phat trien|xuat hien|phan bo|duoc trong|duoc tim thay)",
     r"(?:sinh[\s_]+ra|mọc(?:[\s_]+ra)?|phát[\s_]+triển|xuất[\s_]+hiện|phân[\s_]+bố|được[\s_]+trồng|được[\s_]+tìm[\s_]+thấy)"),
    ("BIRTH_LOCATION", r"(?:sinh(?=\s+(?:o|tai))|chao doi|ra doi)", r"(?:sinh(?=[\s_]+(?:ở|tại))|chào[\s_]+đời|ra[\s_]+đời)"),
    ("DEATH_LOCATION", r"(?:mat|qua doi)", r"(?:mất|qua[\s_]+đời)"),
    ("ORGANIZED_LOCATION", r"(?:duoc to chuc|to chuc)", r"(?:được[\s_]+tổ[\s_]+chức|tổ[\s_]+chức)"),
    ("HEADQUARTERS_LOCATION", r"(?:co tru so|dat tru so)", r"(?:có[\s_]+trụ[\s_]+sở|đặt[\s_]+trụ[\s_]+sở)"),
    ("RESIDENCE_LOCATION", r"(?:sinh song|cu tru|tap trung|song(?=\s+(?:o|tai)))", r"(?:sinh[\s_]+sống|cư[\s_]+trú|tập[\s_]+trung|sống)"),
]
PLACE_PREPOSITION = r"(?:ở|tại|trên|trong)"
PLACE_DESIGNATORS = [
    "be mat", "ben trong", "canh", "chau", "dau", "dao", "dia diem", "huyen", "khu vuc", "la", "lanh tho",
    "mien", "nach", "ngon", "nuoc", "phuong", "quan", "quoc gia", "re", "thanh pho", "than", "thi tran", "tinh", "xa",
]
PLACE_ORGANIZATIONS = [
    "benh vien", "cong ty", "dai hoc", "doanh nghiep", "hoc vien", "tap doan", "to chuc", "truong dai hoc",
    "vien nghien cuu",
]
PLACE_STOP = r"\s+(?:vào|từ|kể[\s_]+từ|năm|tháng|ngày|khi|sau|trước|do|vì|nhằm|để)\b"
PLACE_CLAUSE = r",\s+(?:nơi|mà|vốn|được|đã|sẽ|từng|nhưng|còn|do|vì|khi|trong[\s_]+khi|thủ[\s_]+đô)\b"
PLACE_QUESTION_TAIL = (
    r"\b(?:o dau|tai dau|noi nao|dia diem nao|khu vuc nao|quoc gia nao|nuoc nao|tinh nao)\b.*$"
)
QUESTION_STOPWORDS = [
    "ai", "bao", "cai", "cac", "co", "cong", "cua", "duoc", "gi", "la", "mot", "nao", "nay", "nhung", "o",
    "tai", "the", "thuoc", "tren", "trong", "va",
]
CAUSE_MARKER = r"(?:boi\s+vi|do\s+viec|bat\s+nguon\s+tu|xuat\s+phat\s+tu|vi|do|boi)"
EFFECT_LINK = r"(?:khien|lam\s+cho|dan\s+den|gay\s+ra|nen)"
CAUSE_FALSE_DO = r"(?:tu|thai|toc|muc|che|cuong)\s+$"
CAUSE_STOPWORDS = [
    "ai", "bi", "boi", "cai", "co", "cua", "da", "dang", "do", "duoc", "gi", "khien", "la", "lam", "mot", "nao",
    "nay", "nhung", "o", "phai", "se", "tai", "the", "thi", "trong", "va", "vi", "voi",
]
CAUSE_GROUPS = [
    ["khinh miet", "khinh thuong", "khinh bi", "coi thuong", "khong vua mat", "cam ghet", "ghet bo", "re rung"],
    ["roi khoi", "roi", "bo di", "buoc phai roi", "bi duoi", "truc xuat"],
    ["that bai", "bi danh bai", "thua tran", "thua cuoc"],
    ["thanh cong", "dat duoc", "chien thang", "hoan thanh"],
    ["suy giam", "giam", "thap xuong", "mat gia"],
    ["tang", "gia tang", "phat trien manh", "cao hon"],
]
CAUSE_WEAK_PREFIXES = ["cua", "nhu", "voi", "gom"]
METHOD_BONUS = [
    ("contrast_relation_pattern", 0.30), ("role_relation_pattern", 0.40), ("cause_clause_pattern", 0.32),
    ("purpose_clause_pattern", 0.32), ("method_clause_pattern", 0.32), ("description_sentence_pattern", 0.24),
]
SUBJECT_PHRASE_NOISE = (
    r"\b(bao gom nhung gi|gom nhung gi|co nhung gi|duoc chia thanh|duoc chia lam|duoc chia|chia thanh|chia lam|"
    r"nhu the nao|nhu nao|la gi|la ai|chia|duoc|nao|gi|ai)\b"
)

# --- fixed values: follow-up questions ---------------------------------------------------------

FOLLOWUP = {
    "max_followups": 3, "max_internal_candidates": 10, "min_answerability": 0.62, "min_topic": 0.5,
    "max_context_passages": 12, "surface_similarity": 0.93, "max_probes": 3,
    "w_answerability": 0.45, "w_relevance": 0.25, "w_novelty": 0.2, "w_diversity": 0.1,
}
FOLLOWUP_STOPWORDS = [
    "ai", "bao", "cai", "co", "cua", "duoc", "gi", "la", "nao", "nhung", "o", "tai", "the", "trong", "vao", "ve", "vi", "voi",
]
RELATION_EQUIVALENTS = {"ENTITY": "IDENTITY", "DEFINITION": "IDENTITY", "GENERIC_LOCATION": "LOCATION"}
# relation -> (question type, diversity group, template)
FOLLOWUP_RELATIONS = {
    "BIRTH_TIME": ("TIME", "TIME", "{subject} sinh vào thời gian nào?"),
    "DEATH_TIME": ("TIME", "TIME", "{subject} qua đời vào thời gian nào?"),
    "EVENT_TIME": ("TIME", "TIME", "{target} vào thời gian nào?"),
    "BIRTH_LOCATION": ("LOCATION", "LOCATION", "{subject} sinh ở đâu?"),
    "DEATH_LOCATION": ("LOCATION", "LOCATION", "{subject} qua đời ở đâu?"),
    "EVENT_LOCATION": ("LOCATION", "LOCATION", "{target} diễn ra ở đâu?"),
    "OBJECT_LOCATION": ("LOCATION", "LOCATION", "{subject} nằm ở đâu?"),
    "PROCESS_LOCATION": ("LOCATION", "LOCATION", "{subject} {predicate} ở đâu?"),
    "CAUSE": ("GENERAL", "CAUSE", "Vì sao {target}?"),
    "PURPOSE": ("GENERAL", "PURPOSE", "{target} nhằm mục đích gì?"),
    "CONSEQUENCE": ("GENERAL", "CONSEQUENCE", "{target} dẫn đến kết quả gì?"),
    "ROLE": ("GENERAL", "ROLE", "{subject} từng giữ những chức vụ hoặc vai trò nào?"),
    "EVENT": ("ENTITY", "EVENT", "{subject} tham gia hoặc thực hiện những hoạt động nào?"),
    "ATTRIBUTE": ("NUMBER", "ATTRIBUTE", "{subject} có độ cao bao nhiêu?"),
    "CONTEXT": ("GENERAL", "CONTEXT", "{subject} diễn ra trong bối cảnh nào?"),
    "COMPARISON": ("GENERAL", "COMPARISON", "Tài liệu nêu điểm khác biệt nào liên quan đến {subject}?"),
    "IDENTITY": ("DEFINITION", "IDENTITY", "{subject} là gì?"),
    "EVIDENCE_DETAIL": ("GENERAL", "DETAIL", "Ngoài nội dung vừa trả lời, tài liệu còn cho biết điều gì về {subject}?"),
}
FU_BIRTH = r"\b(?:sinh|chao doi|ra doi)\b"
FU_DEATH = r"\b(?:mat|qua doi|tu tran)\b"
FU_EVENT = r"\b(?:dien ra|xay ra|no ra|khoi nghia|cach mang|chien tranh|hoi nghi|phong trao)\b"
FU_ACTIVITY = r"\b(?:tham gia|lanh dao|chi huy|ky ket|dam phan|sang lap|thanh lap|to chuc|hoat dong)\b"
FU_ACTIVITY_MORE = r"\b(?:duoc gui|gui den|cu den|tham du|thuc hien)\b"
FU_OBJECT_PLACE = r"\b(?:nam|toa lac|dat tai|thuoc)\b.{0,70}\b(?:tai|o|mien|tinh|thanh pho|quoc gia|khu vuc)\b"
FU_OBJECT_PLACE_SURFACE = (
    r"\b(?:nằm|tọa lạc|đặt tại|thuộc)\b.{0,80}\b(?:tại|ở|miền|tỉnh|thành phố|quốc gia|khu vực)\b|"
    r"\b(?:toa lac|dat tai|thuoc)\b.{0,80}\b(?:tai|o|mien|tinh|thanh pho|quoc gia|khu vuc)\b"
)
FU_CONSEQUENCE = r"\b(?:dan den|gay ra|ket qua la|hau qua)\b"
FU_CONTEXT = r"\b(?:trong boi canh|boi canh|trong thoi ky|trong giai doan)\b"
FU_COMPARISON = r"\b(?:khac voi|khac biet|so voi|tuong dong)\b"
FU_TIMED_ACTION = (
    r"\b(?:duoc thanh lap|thanh lap|duoc xay dung|xay dung|bat dau|ket thuc|bi bai bo|bai bo|tro thanh|"
    r"ra mat|phat hien|duoc cong bo|ky ket)\b"
)
FU_HEIGHT = r"\b(?:co do cao|do cao(?: la)?|cao(?: la)?)\b.{0,28}\b\d+(?:[,.]\d+)?\s*(?:m|met|km)\b"
FU_SPATIAL = r"\b(?:sinh ra|moc ra|phat trien|xuat hien|phan bo|sinh song|duoc trong|duoc tim thay)\b.{0,70}\b(?:tai|o)\b"
FU_SPATIAL_WORDS = [
    ("duoc tim thay", "được tìm thấy"), ("duoc trong", "được trồng"), ("sinh ra", "sinh ra"), ("moc ra", "mọc ra"),
    ("phat trien", "phát triển"), ("xuat hien", "xuất hiện"), ("phan bo", "phân bố"), ("sinh song", "sinh sống"),
]
FU_DATE_SURFACE = (
    r"\b(?:ngày|tháng|năm|thế kỷ|thập niên|giai đoạn|thời kỳ)\b|\b(?:1\d{3}|20\d{2})\b|"
    r"\b(?:ngay|thang|the ky|thap nien|giai doan|thoi ky)\b|\bnam\s+(?:1\d{3}|20\d{2})\b"
)
FU_DATE_VALUE = r"\b(?:1\d{3}|20\d{2})\b|\b(?:ngay|thang)\s+\d{1,2}\b|\bthe ky\s+(?:\d+|[ivxlcdm]+)\b|\bthap nien\s+\d+\b"
FU_DATE_FOLDED = r"(?:\b(?:ngay|thang|nam|the ky|thap nien|giai doan|thoi ky)\b|\b(?:1\d{3}|20\d{2})\b)"
FU_PLACE_SURFACE = r"\b(?:tại|ở)\s+\w|\b(?:tai|o)\s+\w"
FU_CAUSE_SURFACE = r"\b(?:bởi vì|vì|do|bởi|nguyên nhân|bắt nguồn từ|xuất phát từ|boi vi|nguyen nhan|bat nguon tu|xuat phat tu)\b"
FU_PURPOSE_SURFACE = r"\b(?:nhằm|(?<!triệt )để|với mục đích|với mục tiêu|nham|voi muc dich|voi muc tieu)\b(?=\s+\w)"
FU_EVENT_SUBJECT = r"\b(?:su kien|cach mang|chien tranh|hoi nghi|phong trao|khoi nghia|cuoc chien)\b"
FU_NOT_PERSON = (
    r"\b(?:chu nghia|thanh pho|dia diem|phan mem|cong trinh|su kien|cach mang|chien tranh|hoi nghi|phong trao|cuoc chien)\b"
)
FU_PERSON_CUE = r"(?:ong|ba|tong thong|thu tuong|chu tich|hoang de|nha vua|dai tuong|tuong)"
FU_ROLE_NOUN = (
    r"(?:co van|lanh dao|giao su|nha van|nha viet kich|thu tuong|tong thong|chu tich|bo truong|dai tuong)"
)
FU_ROLE_VERB = r"(?:voi tu cach|giu chuc|dam nhiem|duoc bau|duoc bo nhiem|tro thanh|la)"
FU_PRONOUN = r"\b(?:ong|ba|nguoi nay|nhan vat nay|vi nay)\b"
FU_LOW_DETAIL = (
    r"\b(?:duoc nhac den|duoc de cap|de cap den)\b|\bnoi ve\b.{0,45}\b(?:tai lieu|van ban|doan van|cau hoi)\b"
)
# relation -> (strength, rule name, predicate word)
FU_STRENGTH = {
    "BIRTH_TIME": (0.93, "explicit_birth_time", "sinh"), "BIRTH_LOCATION": (0.88, "explicit_birth_location", "sinh"),
    "DEATH_TIME": (0.92, "explicit_death_time", "qua đời"), "DEATH_LOCATION": (0.86, "explicit_death_location", "qua đời"),
    "EVENT_TIME": (0.87, "evidenced_event_time", "thời gian"), "EVENT_LOCATION": (0.84, "evidenced_event_location", "địa điểm"),
    "OBJECT_LOCATION": (0.86, "evidenced_object_location", "nằm"), "PROCESS_LOCATION": (0.86, "evidenced_spatial_process", "xuất hiện"),
    "CAUSE": (0.88, "evidenced_cause", "nguyên nhân"), "PURPOSE": (0.83, "evidenced_purpose", "mục đích"),
    "CONSEQUENCE": (0.84, "evidenced_consequence", "kết quả"), "CONTEXT": (0.77, "evidenced_context", "bối cảnh"),
    "ROLE": (0.85, "evidenced_role", "vai trò"), "EVENT": (0.81, "evidenced_activity", "hoạt động"),
    "ATTRIBUTE": (0.90, "evidenced_height", "độ cao"), "COMPARISON": (0.76, "evidenced_comparison", "khác biệt"),
    "IDENTITY": (0.82, "evidenced_identity", "là"), "EVIDENCE_DETAIL": (0.70, "additional_grounded_fact", "chi tiết"),
}

# --- fixed values of subject focus and inference (folded word forms) ------------------
SUBJECT_STRIP = " \t\r\n?!.,;:-\""
SUBJECT_WORD_STRIP = "?!.,;:-\""
SUBJECT_MOST = 120
WEAK_SUBJECTS = ["", "dieu nay", "su kien nay", "viec nay", "no", "ho", "nguoi nay", "doi tuong", "tai lieu", "cau hoi"]
ASKING_WORDS = ["la ai", "la gi", "o dau", "tai dau", "khi nao", "nhu the nao"]
FOCUS_FRAMES = [
    "chuc nang cua", "vai tro cua", "muc dich cua", "dac diem cua", "dac trung cua", "y nghia cua", "lich su cua", "nguon goc cua", "cau tao cua",
    "thanh phan cua", "vi tri cua", "nguyen nhan cua", "hau qua cua",
]
SUBJECT_PATTERNS = [
    r"^(.+?)\s+(?:la ai|la gi)$",
    r"^(.+?)\s+(?:sinh|chao doi|ra doi|mat|qua doi)",
    r"^(.+?)\s+(?:dien ra|xay ra|no ra|nam|toa lac)",
    r"^(?:vi sao|tai sao)\s+(.+?)\s+(?:xay ra|phat trien|gia tang|suy giam)",
    r"^(?:muc dich cua)\s+(.+?)\s+(?:la gi)?$",
]
PROBE_HITS = 5
