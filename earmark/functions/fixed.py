"""Fixed values.

Everything here is a constant whose exact value decides whether results are
right: regular expressions, word lists, enumerations, suffix lists and limits.
They are kept together, in plain text, so they can be read against a format
description; no logic lives in this module.
"""

# Unicode white space, as a Java regex class usable with (?U).
WS = r"[\s\x1c-\x1f]"

# --- fixed values: timed-text patterns -------------------------------------
CLOCK = r"(?:\d{1,3}:)?\d{1,2}:\d{2}(?:[,.]\d{1,3})?"
CUE_RANGE = rf"({CLOCK})\s*-->\s*({CLOCK})"
BRACKET_LINE = rf"^\s*\[({CLOCK})\]\s*(.*)$"
VOICE_TAG = r"(?is)<v(?:\.[^ >]+)?\s+([^>]+)>(.*?)</v>"
SPEAKER_PREFIX = r"(?s)^([^:：]{1,60})[:：]\s+(.+)$"
SPEAKER_MAX_WORDS = 8
CLASS_TAG = r"(?i)</?c(?:\.[^ >]+)?>"
ANY_TAG = r"<[^>]+>"
REPEAT_GAP_SECONDS = 2.0
GROWING_GAP_SECONDS = 1.0

# --- fixed values: tokens ---------------------------------------------------
LATIN_CHARS = "A-Za-z0-9_+#.-"
CJK_CHARS = "㐀-鿿"
LATIN_TERM = f"[{LATIN_CHARS}]{{2,}}"
LATIN_RUN = f"[{LATIN_CHARS}]+"
CJK_RUN = f"[{CJK_CHARS}]+"
KEYWORD = f"[{LATIN_CHARS}]{{2,}}|[{CJK_CHARS}]"
KEYWORD_LIMIT = 20
SENTENCE_BREAK = r"(?U)(?<=[。！？!?；;\.])\s+|\n+"
STOP_TERMS = [
    "这期", "节目", "认为", "看法", "什么", "关系", "如何", "怎么", "怎样",
    "为何", "为什么", "是否", "觉得", "提到", "关于", "他的", "她的", "他们",
]

# --- fixed values: chunking and search ---------------------------------------
MAX_CHARS = 3600
MAX_SECONDS = 300.0
OVERLAP_SEGMENTS = 2
TOP_K = 8
BUDGET_CHARS = 12000
PHRASE_BONUS = 8.0
BOOST_BASE, BOOST_STEP, BOOST_CAP = 4.0, 2.0, 14.0
#: Fields of an evidence item that are searched, by collection.
SEARCHED_FIELDS = {
    "claims": ("claim",),
    "actions": ("action", "for_whom"),
    "entities": ("name", "context"),
    "glossary": ("source_term", "preferred_term", "note"),
}

# --- fixed values: evidence enumerations --------------------------------------
CLAIM_KINDS = ["fact", "opinion", "anecdote", "prediction", "recommendation", "synthesis"]
SUPPORT_KINDS = ["stated", "illustrated", "argued", "asserted", "contradicted"]
CONFIDENCE_LEVELS = ["high", "medium", "low"]
VERIFICATION_STATES = ["not_checked", "supported", "mixed", "contradicted", "outdated", "not_verifiable"]
ENTITY_TYPES = ["person", "organization", "product", "book", "paper", "concept", "tool"]

# --- fixed values: file suffixes ----------------------------------------------
MEDIA_SUFFIXES = [".mp3", ".m4a", ".mp4", ".wav", ".aac", ".ogg", ".opus", ".flac", ".webm", ".mkv", ".mov"]
AUDIO_SUFFIXES = [".mp3", ".m4a", ".wav", ".aac", ".ogg", ".opus", ".flac"]
VIDEO_SUFFIXES = [".mp4", ".mkv", ".mov", ".webm"]
TRANSCRIPT_SUFFIXES = [".srt", ".vtt", ".txt", ".md", ".json", ".json3", ".ass", ".ttml", ".lrc"]
PAGE_TRANSCRIPT_SUFFIXES = [".srt", ".vtt", ".txt", ".md", ".json"]
FEED_SUFFIXES = [".xml", ".rss", ".atom"]
METADATA_NAMES = ["source.json", "source-info.json", "ingest-result.json", "bundle.json"]
ANALYSIS_NAMES = ["analysis.md", "summary.md", "evidence.json"]
ALWAYS_SHARED = ["bundle.json", "source.json", "source-info.json", "analysis.md", "summary.md",
                 "evidence.json", "reader.html", "analysis-handoff.json"]
FULL_TEXT_NAMES = ["transcript.json", "transcript.md", "transcript.srt", "transcript.vtt", "chunks.json"]
CACHE_DIRS = ["audio-chunks", "chunk-transcripts", ".invalid-cache"]
PRESERVED_NAMES = ["transcript.json", "transcript.md", "transcript.srt", "transcript.vtt", "chunks.json",
                   "analysis.md", "summary.md", "evidence.json", "bundle.json", "source.json", "reader.html"]

# --- fixed values: URLs and privacy --------------------------------------------
SENSITIVE_KEY = r"(?i)(?:token|sig(?:nature)?|auth|secret|session|jwt|key|policy|expires?|credential|hdnea)"
TRACKER_KEY = r"(?i)^(?:utm_.*|fbclid|gclid)$"
LOCAL_PATH = r"""(?:(?:[A-Za-z]:[\\/])|/Users/|/home/)[^\s"'<>]+"""
REMOTE_URL = r"""https?://[^\s'"]+"""
CONTENT_TYPE_SUFFIX = {
    "audio/mpeg": ".mp3", "audio/mp4": ".m4a", "audio/x-m4a": ".m4a",
    "audio/ogg": ".ogg", "audio/opus": ".opus", "audio/flac": ".flac",
    "audio/wav": ".wav", "video/mp4": ".mp4", "video/webm": ".webm",
}

# --- fixed values: report checks ------------------------------------------------
STAMP = r"\[(?:\d{1,3}:)?\d{2}:\d{2}(?:\s*[–—-]\s*(?:\d{1,3}:)?\d{2}:\d{2})?\]"
STAMP_PART = r"(?:\d{1,3}:)?\d{2}:\d{2}"
PLACEHOLDER = (r"(?i)\{(?:episode|title|source|show|date|duration|speaker|summary|topic)[^}]*\}"
               r"|\b(?:TODO|TBD|FIXME)\b|（待补|待填写|待确认）")
SOURCE_LINE = r"(?im)^[-|]\s*(?:source|来源|原始链接|节目链接)\s*[:|：]"
HEADING_WORDS = {
    "summary": ["总结", "summary", "核心结论", "executive"],
    "chapters_or_timeline": ["章节", "时间线", "timeline", "chapter"],
    "limitations": ["限制", "不确定", "limitation", "uncertainty", "可信度"],
}

# --- fixed values: subtitle languages ---------------------------------------------
SIMPLIFIED = ["zh-cn", "zh-hans", "zh-sg"]
TRADITIONAL = ["zh-tw", "zh-hant", "zh-hk", "zh-mo"]
MAX_TRACKS = 16
MAX_CANDIDATES = 20
