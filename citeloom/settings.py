"""Fixed values and size bounds.

The first group must equal published behaviour for results to agree, so the values are stated
plainly here and nowhere else. The second group is this engine's own.
"""

# --- fixed values: chunk sizes, in characters ---
TARGET_CHARS = 1200
MAX_CHARS = 1600
OVERLAP_CHARS = 180
MIN_CHARS = 200
INTRO_CHARS = 400

# --- fixed values: retrieval ---
TOP_K = 5
POOL = 20
RRF_CONSTANT = 3
RETRIEVAL_MODES = ("hybrid", "vector", "keyword")

# --- fixed values: Okapi BM25 ---
BM25_K1 = 1.5
BM25_B = 0.75
BM25_EPSILON = 0.25

# --- fixed values: embeddings and model calls ---
EMBEDDING_DIM = 768
EMBED_BATCH = 100
DOCUMENT_TASK = "RETRIEVAL_DOCUMENT"
QUERY_TASK = "RETRIEVAL_QUERY"
UNIT_NORM_ATOL = 1e-3
UNIT_NORM_RTOL = 1e-5
EMBED_ATTEMPTS = 3
MODEL_ATTEMPTS = 4
MAX_RETRY_WAIT = 90.0

# --- fixed values: golden set vocabulary ---
QUESTION_TYPES = ("factual", "multi_hop", "contradiction", "underspecified", "unanswerable")
PHRASINGS = ("prose", "code")
COHORTS = ("original", "extended")

# --- fixed values: what Python's str.strip() and str.split() call whitespace ---
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# --- this engine's own: decimals kept when scores are compared ---
# Similarity and BM25 scores are double sums whose last bits depend on the order of addition, so
# they are compared after rounding. 1e-8 is finer than single precision.
SCORE_DECIMALS = 8
MEAN_IDF_DECIMALS = 9

# --- this engine's own: what may travel to every task (checked, never assumed) ---
# Cells of a query matrix (queries x dimensions): 4M doubles are 32 MB.
MAX_SHIPPED_QUERY_CELLS = 4_000_000
# (query, term) weights: 1M rows are about 40 MB.
MAX_SHIPPED_WEIGHTS = 1_000_000
# Scores that one block of a task may hold at a time: 4M doubles are 32 MB.
MAX_SCORE_CELLS = 4_000_000
