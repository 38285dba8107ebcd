"""Values that results depend on.  Everything here is data, not logic."""

from __future__ import annotations

# --- fixed values: article validation and text sizing -----------------------
MIN_CONTENT_CHARS = 100
CHARS_PER_TOKEN = 4
CHUNK_TOKENS = 512
OVERLAP_TOKENS = 50
ARTICLE_SUMMARY_INPUT_CHARS = 15000

# --- fixed values: preview lengths ------------------------------------------
RESULT_PREVIEW_CHARS = 500
SUMMARY_INPUT_CHARS = 500
COMPARE_PREVIEW_CHARS = 400
RESEARCH_PREVIEW_CHARS = 600
DAILY_PREVIEW_CHARS = 300
LATEST_SUMMARY_CHARS = 150
HISTORY_PREVIEW_CHARS = 200
STREAM_SLICE_CHARS = 20

# --- fixed values: crawl limits ---------------------------------------------
HOME_LINK_CAP = 100
CATEGORY_LINK_CAP = 50
MIN_LINK_TEXT_CHARS = 10
BACKFILL_DAYS = 7
MAX_SLUG_CHARS = 80

# --- fixed values: crawl seed categories and their site paths ----------------
SEED_PATHS = {
    "home": "/",
    "world": "/world",
    "china": "/world/china",
    "tech": "/tech",
    "finance": "/finance",
    "business": "/business",
    "politics": "/politics",
    "economy": "/economy",
    "opinion": "/opinion",
    "arts": "/arts-culture",
    "lifestyle": "/lifestyle",
    "real-estate": "/real-estate",
    "personal-finance": "/personal-finance",
    "health": "/health",
    "style": "/style",
    "sports": "/sports",
    "us-news": "/us-news",
}

# --- fixed values: path of a day's archive page ------------------------------
ARCHIVE_PATH_FORMAT = "yyyy/MM/dd"
ARCHIVE_PATH_PREFIX = "/news/archive/"

# --- fixed values: URL fragments that never hold an article ------------------
NON_ARTICLE_FRAGMENTS = [
    "/video/",
    "/livecoverage/",
    "/podcasts/",
    "/buyside/",
    "/coupons/",
    "/news/types/",
    "/news/author/",
    "/puzzles/",
    "/audio/",
    "/print-edition/",
    "/digital-print-edition",
    "/client/",
    "/market-data/",
]

# --- fixed values: URL fragment -> category, first match wins ----------------
CATEGORY_RULES = [
    ("/world/china", "china"),
    ("/china/", "china"),
    ("/world/asia", "asia"),
    ("/asia/", "asia"),
    ("/tech/", "tech"),
    ("/technology/", "tech"),
    ("/world/", "world"),
    ("/finance/", "finance"),
    ("/markets/", "finance"),
    ("/business/", "business"),
    ("/politics/", "politics"),
    ("/economy/", "economy"),
    ("/arts-culture/", "arts"),
    ("/arts/", "arts"),
    ("/culture/", "arts"),
    ("/lifestyle/", "lifestyle"),
    ("/opinion/", "opinion"),
    ("/us-news/", "us"),
    ("/personal-finance/", "personal-finance"),
    ("/sports/", "sports"),
    ("/real-estate/", "real-estate"),
    ("/health/", "health"),
    ("/style/", "style"),
    ("/free-expression/", "free-expression"),
    ("/articles/", "miscellaneous"),
]
DEFAULT_CATEGORY = "uncategorized"

# --- fixed values: category display names ------------------------------------
CATEGORY_DISPLAY = {
    "home": "综合",
    "world": "国际",
    "china": "中国",
    "tech": "科技",
    "finance": "金融",
    "business": "商业",
    "politics": "政治",
    "economy": "经济",
    "opinion": "观点",
    "arts": "文化",
    "lifestyle": "生活",
    "health": "健康",
    "sports": "体育",
    "us-news": "美国",
    "real-estate": "房产",
    "personal-finance": "个人理财",
    "style": "时尚",
}

# --- fixed values: weekday names, Monday first -------------------------------
WEEKDAYS = ["星期一", "星期二", "星期三", "星期四", "星期五", "星期六", "星期日"]

# --- fixed values: time-zone words dropped from the end of a date ------------
ZONE_WORDS = ["et", "est", "edt", "pt", "pst", "pdt", "utc", "gmt"]

# --- fixed values: month spellings; "may." is not one of them ----------------
MONTH_NUMBERS = {
    "january": 1, "jan": 1, "jan.": 1,
    "february": 2, "feb": 2, "feb.": 2,
    "march": 3, "mar": 3, "mar.": 3,
    "april": 4, "apr": 4, "apr.": 4,
    "may": 5,
    "june": 6, "jun": 6, "jun.": 6,
    "july": 7, "jul": 7, "jul.": 7,
    "august": 8, "aug": 8, "aug.": 8,
    "september": 9, "sep": 9, "sep.": 9, "sept": 9, "sept.": 9,
    "october": 10, "oct": 10, "oct.": 10,
    "november": 11, "nov": 11, "nov.": 11,
    "december": 12, "dec": 12, "dec.": 12,
}

# --- fixed values: English stop words of the "standard" search analyzer ------
STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in",
    "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the",
    "their", "then", "there", "these", "they", "this", "to", "was", "will",
    "with",
]

# --- fixed values: keyword search -------------------------------------------
BM25_K1 = 1.2
BM25_B = 0.75
FIELD_BOOSTS = {
    "title": 3.0,
    "content": 1.0,
    "article_summary": 2.0,
    "chunk_summary": 1.0,
}

# --- fixed values: result sizes, look-backs and weights ----------------------
API_WEIGHTS = (0.7, 0.3)
TOOL_WEIGHTS = (0.6, 0.4)
RECENT_LIMIT = 50
LATEST_LIMIT = 5
DEFAULT_RECENT_HOURS = 72
SESSION_TTL_MINUTES = 30
SESSION_MESSAGE_LIMIT = 50
PROMPT_MESSAGE_LIMIT = 20
FEEDBACK_LIMIT = 3

# --- fixed values: argument ranges of the tools ------------------------------
CLAMPS = {
    "query_results": (1, 20),
    "trend_hours": (1, 720),
    "trend_topics": (1, 10),
    "compare_per_topic": (1, 5),
    "research_results": (3, 20),
    "database_limit": (1, 20),
}


def clamp(name: str, value: int) -> int:
    low, high = CLAMPS[name]
    return max(low, min(high, value))
