"""Word lists, patterns and constants of the pipeline, as data."""

# Segment cleaning (stage 2)
BRACKET_WORDS = ("inaudible", "applause", "laughter", "music", "silence", "noise", "crosstalk")
LEADING_FILLERS = ("uh", "um", "erm", "er", "ah", "hmm", "mm", "okay", "ok", "well", "so", "yeah")
INLINE_FILLERS = ("uh", "um", "erm", "er", "ah", "hmm", "mm")
INLINE_PHRASES = ("you know", "i mean")

# Chunk cleaning (stage 3)
CONTRACTIONS = {
    "dont": "don't", "wont": "won't", "cant": "can't", "ive": "I've", "im": "I'm", "thats": "that's", "id": "I'd", "youd": "you'd",
    "theyd": "they'd", "weve": "we've", "theres": "there's", "wheres": "where's", "whats": "what's", "youre": "you're",
    "theyre": "they're", "youll": "you'll", "theyll": "they'll",
}
CHUNK_FILLER_PHRASES = ("you know", "i mean", "sort of", "kind of", "so basically", "i think")
CHUNK_FILLER_WORDS = ("um", "uh", "ah", "er", "like", "basically", "actually", "literally", "honestly")

# Context cleaning (stage 8)
CONTEXT_FILLERS = ("okay", "right", "you know", "kind of", "sort of", "basically", "actually", "uh", "um", "AUDIO OUT")

# Oldest cleaner
V1_MARKERS = ("[INAUDIBLE]", "[APPLAUSE]", "[LAUGHTER]", "[MUSIC]", "[SILENCE]")
V1_FILLERS = ("ok", "yeah", "uh", "um", "oh", "ah", "hey", "alright", "so", "like", "actually", "literally", "basically", "totally", "i mean", "you know", "i guess", "i suppose")

# Embedding cleaner
EMBEDDING_FILLERS = ("like", "basically", "you know", "kind of", "I think", "I mean", "so basically", "well", "yeah", "okay", "right", "sure", "actually", "really", "just", "maybe", "perhaps", "probably", "certainly", "of course")

# Greedy packing
V3_MIN_TOKENS, V3_HARD_TOKENS, V3_MAX_SECONDS, V3_MIN_SECONDS, V3_GAP = 150, 220, 90.0, 20.0, 3.0
V2_WORDS, V2_TOKENS, V2_SECONDS, V2_MIN_WORDS, V2_GAP, V2_OVERLAP = 160, 180, 90.0, 50, 8.0, 2
V1_SECONDS, V1_MIN_WORDS = 30.0, 10
MERGE_TOKENS, MERGE_SECONDS, MERGE_THRESHOLD = 230, 120.0, 0.65
LEXICAL_SECONDS, LEXICAL_WORDS, LEXICAL_OVERLAP = 120.0, 250, 0.05

STOPWORDS = """a an the and or but so of to in on for with is are was were be been being that this these those it its as at by from if then
    than into about also we you they he she i me our your their my them what which who when where why how do does did can could would
    should have has had not just there here""".split()
CONTINUATIONS = ("and ", "but ", "so ", "because ", "then ", "now ", "for example", "for instance", "in other words", "that means", "this means", "which means", "however", "meanwhile")
TOPIC_SHIFTS = ("now let's", "let's move", "moving on", "next ", "in summary", "to summarize", "the key idea")

# Enrichment: keyword -> hint, in order of precedence
KEYWORDS = {
    "reinforcement learning": "hoc tang cuong", "machine learning": "hoc may", "language model": "mo hinh ngon ngu", "self-attention": "tu chu y",
    "multi-head": "nhieu dau", "learning rate": "toc do hoc", "fine-tuning": "tinh chinh", "fine tuning": "tinh chinh",
    "backpropagation": "lan truyen nguoc", "tokenization": "tach token", "transformer": "transformer", "attention": "chu y",
    "optimization": "toi uu", "validation": "kiem dinh", "regularization": "chinh quy", "hyperparameter": "sieu tham so",
    "tokenizer": "bo tach token", "vocabulary": "tu vung", "embedding": "nhung", "convolutional": "tich chap", "recurrent": "hoi quy",
    "probability": "xac suat", "inference": "suy luan", "gradient": "dao ham", "activation": "kich hoat", "training": "huan luyen",
    "learning": "hoc", "network": "mang", "neural": "neural", "vector": "vec to", "tensor": "tensor", "softmax": "softmax", "logit": "logit",
    "reward": "phan thuong", "policy": "chinh sach", "agent": "tac tu", "action": "hanh dong", "encoder": "bo ma hoa",
    "decoder": "bo giai ma", "token": "token", "gpt": "gpt", "bert": "bert", "llm": "llm",
}
TOPICS = {
    "Transformer/Attention": ("transformer", "attention", "self-attention", "multi-head", "encoder", "decoder"),
    "Training/Optimization": ("training", "learning rate", "optimizer", "gradient", "loss", "backprop", "fine-tuning", "fine tuning"),
    "NLP/Language Models": ("language model", "token", "tokenizer", "bert", "gpt", "embedding", "vocabulary"),
    "Reinforcement Learning": ("reward", "policy", "agent", "action", "environment"),
    "Neural Networks": ("neural", "network", "layer", "weight", "bias"),
    "Computer Vision": ("image", "pixel", "convolution", "cnn", "feature"),
}
DEFAULT_TOPIC = "General AI/ML"
EMBEDDING_TOKENS, MAX_KEYWORDS, MIN_KEYWORDS = 240, 6, 3

# Rule-based language detection
DIACRITICS = "àáạảãâầấậẩẫăằắặẳẵèéẹẻẽêềếệểễìíịỉĩòóọỏõôồốộổỗơờớợởỡùúụủũưừứựửữỳýỵỷỹđ"
ENGLISH_STRONG = """what how why when where which who explain describe define tell show give is are was were does did can the and or but for
    with this that it from have has been will would could should about into over after their there these those some any all each every
    both few more most other such not only same so than too very just make take come see know think want use find try call ask work seem
    feel leave put keep let begin become hear play run move live believe bring happen write provide sit stand lose meet continue set
    learn change lead understand mechanism function works difference different between compare algorithm model training inference
    embedding network layer parameter gradient optimizer loss accuracy""".split()
ENGLISH_MEDIUM = "into over under through during before after above below between while although though because since until unless however therefore otherwise".split()
#: Entries of more than one word are left out: a single token can never equal them.
VIETNAMESE_STRONG = """gi nao dau sao khong ko duoc dc trong voi den tren duoi cua cac cho nhung neu khi con the co cung nay kia lam cach hoat
    dong giai thich thcih nghia hieu phan buoc laf gif gifs dogn sai tai nhu""".split()
VIETNAMESE_PATTERNS = (
    (r"\bla\s+gi\b", 1.0), (r"\bla\s+[a-z]{1,5}\b", 0.6), (r"\bla\s+\w+", 0.5), (r"\bcó\s+không\b", 0.9), (r"\bco\s+khong\b", 0.8),
    (r"\bco\s+\w+", 0.4), (r"\btai\s*s(a)?o\b", 0.9), (r"\bvi\s*sao\b", 0.9), (r"\bhoat\s*d(on)?g\b", 0.8), (r"\bhoạt\s*động\b", 0.9),
    (r"\bgiai\s*t(h)?ich\b", 0.8), (r"\bgiải\s*thích\b", 0.9), (r"\bcông\s*thức\b", 0.9), (r"\bcong\s*thuc\b", 0.8),
    (r"\bla\s+\w{1,4}\b", 0.7), (r"\bcó\s+\w+", 0.5), (r"\bnao\b", 0.7), (r"\bnhu\s+nao\b", 0.8),
)

# Answer metrics
ANSWER_STOPWORDS = """a an the is are was were be been of to in on for with by as at and or but if this that these those it its
    là của và có được trong cho với này đó thì một các những khi để không ra vào đến từ tại về như đã sẽ rồi nữa""".split()

# Retrieval
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25
RRF_K, ALPHA = 60, 0.6
