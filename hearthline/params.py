"""Parameters of the listing jobs.

Everything a run can vary is in two frozen dataclasses: ``RulePack`` holds the language-specific word lists and
patterns, ``ScreenParams`` the limits.  The Hebrew pack is the default, not an assumption of the code.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------------------------------------------
# Verdicts and other stored labels.
# ---------------------------------------------------------------------------------------------------------------
ADDED = "added"
REJECTED_PRICE = "rejected_price"
REJECTED_ROOMS = "rejected_rooms"
REJECTED_DISTANCE = "rejected_distance"
PREFILTERED = "prefiltered"
PARSE_FAILED = "parse_failed"
PRICE_UNKNOWN = "price_unknown"

VERDICTS = (
    ADDED,
    REJECTED_PRICE,
    REJECTED_ROOMS,
    REJECTED_DISTANCE,
    PREFILTERED,
    PARSE_FAILED,
    PRICE_UNKNOWN,
)

# Verdicts that a reprocessing run looks at again.
RETRY_VERDICTS = (REJECTED_PRICE, REJECTED_ROOMS, PARSE_FAILED, PRICE_UNKNOWN, REJECTED_DISTANCE)

# Where a distance came from.
SOURCE_MEASURED = "google_maps"
SOURCE_NO_ROUTE = "google_maps_failed"
SOURCE_ERROR = "google_maps_error"
SOURCE_CACHE = "cache"
SOURCE_SKIPPED = "skipped"
SOURCE_QUOTA = "quota"

# ---------------------------------------------------------------------------------------------------------------
# Hebrew words and patterns (Java regular expressions; (?U) gives \s, \d and \b their Unicode meaning).
# ---------------------------------------------------------------------------------------------------------------
DIRECTION_MARKS = r"[‎‏‪-‮⁦-⁩]"
COMMENT_MARKERS = (
    r"View more comments|View \d+ repl|Write a (?:public )?comment|Submit your first comment|Most relevant"
)
LINKS = r"https?://\S+|www\.\S+"

SHARED_FLAT = r"שות[פף]"
COUPLE_NEAR_SHARED = r"(?s)(?<!מי)זוג(?!י).{0,30}שות[פף]|שות[פף].{0,30}(?<!מי)זוג(?!י)"
DISQUALIFYING = r"סאבלט|סטודיו|קליניקה|מחפש|מחפשת|מחפשים|מחפשות"
SALE_PRICE = r"(?U)(?<!\d)[1-9]\d{0,2}(?:[.,]\d{3}){2,}(?!\d)|[1-9](?:\.\d+)?\s*(?:מיליון|מליון)"
TARGET_ROOMS = r"(?U)(?<!\d)(3|3\.5)\s*חד|שלוש[ה]?\s*חד|שלוש[ה]?\s*וחצי\s*חד|(?<!\d)3\s*וחצי\s*חד"
ROOMS_MENTION = r"(?U)([1-9](?:\.5)?)\s*חד"

THOUSANDS_SEPARATOR = r"(?U)(?<=[0-9])[.,\s](?=[0-9]{3}(?![0-9]))"
PRICE_MARKER = r"""(?:₪|ש["״]?ח|שכ["״]?ד|שכר\s*דירה|מחיר|לחודש)"""
PRICE_NEAR_MARKER = (
    rf"(?U){PRICE_MARKER}\D{{0,25}}(?<![0-9])[0-9]{{4,5}}(?![0-9])"
    rf"|(?<![0-9])[0-9]{{4,5}}(?![0-9])\D{{0,25}}{PRICE_MARKER}"
)

FEE_PER_MONTH = r"לחודש(?!יים)"
FEE_INCLUDED = "כלול"

FLOOR_WORDS = (
    ("קרקע", 0),
    ("ראשונה", 1),
    ("שניה", 2),
    ("שנייה", 2),
    ("שלישית", 3),
    ("רביעית", 4),
    ("חמישית", 5),
    ("שישית", 6),
    ("שביעית", 7),
    ("שמינית", 8),
    ("תשיעית", 9),
    ("עשירית", 10),
)

AGENT_DENIED = r"(?U)ללא\s+תיווך|לא\s+מתיווך|בלי\s+תיווך|לא\s+תיווך"
AGENT_WORDS = r"""תיווך|נדל["״]?ן"""

PARKING_NONE = r"(?U)אין\s*חניה|בלי\s*חניה|ללא\s*חניה|^אין\z"
PARKING_PRIVATE = r"(?U)פרטי|טאבו|מקור|צמוד|תת\s*קרקעי|חניון"
PARKING_STREET = r"רחוב|ציבור|חופשית"
PARKING_LABELS = ("לא", "פרטית", "ברחוב")

NOT_HEBREW = r"""(?U)[^֐-׿\d\s.,\-/\\'"()\[\]]+"""
EDGE_PUNCTUATION = " \t-–—,/"
IMMEDIATE_WORDS = r"(?U)מיידי|מיד|עכשיו|כניסה\s*מיידית|היום"
IMMEDIATE_LABEL = "מיידי"

INVENTED_ADDRESS = "נמל התעופה"
INVENTED_ADDRESS_EVIDENCE = ("נמל התעופה", "שדה תעופה")

ADDRESS_UNSTATED = "לא צוין"
CITY_TOKENS = r"""(?U)רמת[\s-]?גן|גבעתיים|תל[\s-]?אביב|ר["״]?ג\b|\bרג\b"""
ADDRESS_PUNCTUATION = r"""[",./\-–—_]"""
CITY_ONLY = ("רמת גן", "רמת-גן", "גבעתיים", "תל אביב", 'ר"ג', "ר״ג")
HEBREW_LETTER = r"[֐-׿]"
STREET_WORDS = r"רחוב|רח׳|שדרות|שד׳|דרך|סמטת|סמטה|כיכר|משעול"
LANDMARK_WORDS = r"ליד|בסמוך|קרוב ל|צמוד ל|באזור|בשכונת|שכונת"
ANCHOR_CITIES = ("רמת גן", "גבעתיים", "תל אביב", "רמת-גן", 'ר"ג')
ANCHOR_SUFFIX = ", רמת גן, גבעתיים, ישראל"
SPELLING_REPAIRS = (
    (r"(?U)\bרג\b", "רמת גן"),
    (r"(?U)\bגיבעתיים\b", "גבעתיים"),
    (r"(?U)\bשיינקין\b", "שינקין"),
)

WARN_MISSING = "כתובת חסרה"
WARN_CITY_ONLY = "כתובת ברמת עיר בלבד"
WARN_INVALID = "כתובת לא תקינה"
WARN_LANDMARK = "כתובת לפי שכונה/ציון דרך - לבדיקה"
WARN_SHORT = "כתובת קצרה/כללית מדי"
WARN_NO_STREET = "כתובת ללא אינדיקציה ברורה לרחוב"
WARN_WEAK = "כתובת חלשה - לא נשלחה לגיאוקודינג"
WARN_QUOTA = "מכסה חודשית הסתיימה"
WARN_LOOKUP_ERROR = "שגיאת אימות כתובת"
WARN_NOT_FOUND = "Google לא מצא את הכתובת"
WARN_WRONG_CITY = "הכתובת לא אומתה בעיר יעד"
WARN_IMPRECISE = "Google החזיר תוצאה כללית בלבד"
WARN_NO_ROUTE = "Distance Matrix לא החזיר מסלול תקין"
WARN_ROUTE_ERROR = "שגיאת Distance Matrix"

YES_LABEL, NO_LABEL = "כן", "לא"

LISTING_HEADERS = (
    "לינק למודעה",
    "מחיר",
    "חדרים",
    'מרחק הליכה (ק"מ)',
    "תאריך כניסה",
    "קומה",
    "מעלית",
    "חניה",
    "ארנונה (לחודשיים)",
    "ועד בית (לחודשיים)",
    'ממ"ד/מקלט',
    "תיווך/פרטי",
    "תאריך פרסום",
    "כתובת",
    "זמן סריקה",
)

# English month names of the feed's absolute dates.
MONTHS = {
    "jan": 1, "january": 1, "feb": 2, "february": 2, "mar": 3, "march": 3, "apr": 4, "april": 4, "may": 5,
    "jun": 6, "june": 6, "jul": 7, "july": 7, "aug": 8, "august": 8, "sep": 9, "sept": 9, "september": 9,
    "oct": 10, "october": 10, "nov": 11, "november": 11, "dec": 12, "december": 12,
}

# Geocoding result and component types that prove a street.
PRECISE_RESULT_TYPES = ("street_address", "premise")
PRECISE_COMPONENT_TYPES = ("route",)
STREET_LEVEL_TYPES = ("route", "street_address", "premise", "subpremise")
CITY_COMPONENT_TYPES = ("locality", "administrative_area_level_2", "administrative_area_level_1")

# Links that lead to a post.
POST_LINK_SEGMENTS = ("/posts/", "/permalink/", "/marketplace/item/")
COMMENT_LINK_TOKEN = "comment_id"


@dataclass(frozen=True)
class RulePack:
    """Ordered word lists and patterns of the text rules."""

    excluded_places: tuple[str, ...] = ("בני ברק",)
    shared_flat: str = SHARED_FLAT
    couple_near_shared: str = COUPLE_NEAR_SHARED
    disqualifying: str = DISQUALIFYING
    sale_price: str = SALE_PRICE
    target_rooms: str = TARGET_ROOMS
    rooms_mention: str = ROOMS_MENTION


@dataclass(frozen=True)
class ScreenParams:
    """Limits and switches; the defaults are the reference values."""

    rules: RulePack = field(default_factory=RulePack)
    min_chars: int = 20
    min_rooms: float = 3.0
    max_rooms: float = 3.5
    min_price: int = 5500
    max_price: int = 6700
    absurd_price_low: int = 3000
    absurd_price_high: int = 30000
    include_price_unknown: bool = False
    max_age_days: int = 21
    max_parse_attempts: int = 3
    response_tries: int = 2
    max_vaad: int = 2400
    max_arnona: int = 3000
    max_distance_km: float = 4.0
    validate_addresses: bool = True
    confident_addresses_only: bool = True
    target_cities: tuple[str, ...] = ("רמת גן", "גבעתיים", "תל אביב-יפו", "תל אביב")
    home_cities: tuple[str, ...] = ("רמת גן", "גבעתיים")
    neighbour_city: str = "תל אביב"
    neighbour_limit_m: int = 4000
    monthly_call_cap: int = 9000
    on_cap: str = "skip"
    quota_alert_share: float = 0.8
    prompt_language: str = "en"
    prompt_chars: int | None = None  # the whole text unless the caller sets a window
    snippet_chars: int = 100
