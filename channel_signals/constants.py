"""Results depend on each of them being exactly as written."""

# --- fixed values: feature columns, in model order ---------------------------
STATIC_FEATURES = [
    "time_interval_std",
    "upload_burst_ratio",
    "video_upload_frequency",
    "view_per_video",
    "dash_density",
    "title_length_std",
    "capitalization_ratio",
    "opening_repeat_ratio",
    "temporal_clickbait_ratio",
    "type_token_ratio",
    "avg_title_similarity",
    "sub_to_view_ratio",
    "subscriber_velocity",
]
VELOCITY_RATIO = "sub_to_view_velocity_ratio"
ALL_FEATURES = STATIC_FEATURES + [VELOCITY_RATIO]
META_COLUMNS = ["subscriber_count", "view_count", "video_count", "n_videos_crawled"]
SENTINEL_COLUMNS = ["time_interval_std", "video_upload_frequency", "subscriber_velocity"]
ANOMALY_COLUMN = "if_anomaly_score"

# --- fixed values: labels ----------------------------------------------------
GENUINE, SLOP = 0, 1
LABEL_NAMES = {0: "genuine", 1: "slop"}

# --- fixed values: feature parameters ----------------------------------------
MAX_GAP_DAYS = 365.0
BURST_SHARE = 0.3
MIN_TIMESTAMPS = 3
SIMILARITY_TITLES = 10
SIMILARITY_TERMS = 5000
OPENING_TOKENS = 3
UPLOADS_PER_CHANNEL = 50
VIETNAMESE_MIN_LETTERS = 3
VIETNAMESE_LETTERS = (
    "àáảãạâầấẩẫậăằắẳẵặèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵđ"
)
DASHES = "—|--|–"

# --- fixed values: click-bait phrases (regular expressions) ------------------
CLICKBAIT_PHRASES = [
    r"(?i)\byou (won'?t|will never) believe\b",
    r"(?i)\bthe (dark |hidden |shocking |untold |real |secret )?truth\b",
    r"(?i)\bwhat (nobody|no one) tells you\b",
    r"(?i)\bchanged (everything|the world|history)\b",
    r"(?i)\bmost people don'?t know\b",
    r"(?i)\bgenius of\b",
    r"(?i)\bexplained (simply|in \d+ minutes?)\b",
    r"(?i)\bthis (changes|will change) everything\b",
    r"(?i)\bthe (mind|brain) of\b",
    r"(?i)\bfeynman (explains|on|about|method)\b",
    r"(?i)\beinstein (explains|on|about)\b",
    r"(?i)\bcarl sagan (on|about|explains)\b",
    r"(?i)\bnot .{1,30} but\b",
    r"(?i)\bfew people (know|realize)\b",
    r"ít ai biết",
    r"sự thật (kinh hoàng|bí ẩn|đáng sợ|không ngờ)",
    r"không phải .{1,20} mà là",
    r"(bí mật|bí ẩn) (đằng sau|của|về)",
    r"tại sao (không ai|ít người)",
    r"review phim",
]

# --- fixed values: interval anomaly model ------------------------------------
FOREST_TREES = 100
FOREST_CONTAMINATION = 0.15
FOREST_SAMPLE = 256
SEED = 42

# --- fixed values: classifier ------------------------------------------------
RF_TREES = 200
RF_DEPTH = 8
TEST_SHARE = 0.2
FOLDS = 5
NOTEBOOK_TREES = 300

# --- fixed values: curation --------------------------------------------------
SLOP_THRESHOLD = 0.92
SLOP_SURE_THRESHOLD = 0.97
GENUINE_THRESHOLD = 0.15
SELF_TRAINING_CONFIDENCE = 0.95
MAX_NEW_PER_CLASS = 50
MIN_SUBSCRIBERS = 1000
MIN_VIDEOS = 10
MIN_VIEWS = 10000
LOW_RESULT_UPLOADS = 10
EXCLUDE_KEYWORDS = [
    "rain sound", "sleep music", "relaxing white noise", "lofi hip hop",
    "meditation music", "asmr", "deep sleep", "10 hours",
]
LOW_RESULT_QUERIES = [
    "nhạc lofi chill giảm stress",
    "âm thanh mưa ngủ ngon 8 tiếng",
    "lofi hip hop radio to relax",
    "deep sleep rain sounds 10 hours",
]
