"""Fixed values.

Every constant here must equal the behaviour being reproduced for results to
match (labels, thresholds, keyword rules, weights, codes).  They are kept
together, in their natural order, as plain text.
"""

# ---------------------------------------------------------------- fixed values
# POS ingest
RETURN_MARKER = "반품"            # sales code marking a return
DEFAULT_POS_CATEGORY = "BEVERAGE"  # category kept by the tolerant loader
STRICT_POS_CATEGORY = "Beverage"   # exact category kept by the strict loader
NULL_ITEM_TOKENS = ("", "nan", "None")

# enrichment defaults for a bare daily-demand frame
DEFAULT_LEAD_TIME_DAYS = 2
DEFAULT_REVIEW_PERIOD_DAYS = 2
DEFAULT_MOQ = 5
DEFAULT_UNIT_MARGIN = 1500.0
DEFAULT_UNIT_HOLDING_COST = 180.0
DEFAULT_UNIT_COST = 0.0
SIMULATED_STOCK_FACTOR = 0.8

# features
LAGS = (1, 7, 14, 28)
ROLL_WINDOWS = (7, 14)
TREND_WINDOW = 28
MAJOR_EVENT_SCORE = 70
NO_HOLIDAY_DISTANCE = 999
FEATURE_COLUMNS = (
    "item_id", "temp_c", "rain_mm", "is_holiday", "promo", "event_score_100", "is_event",
    "major_event_flag", "event_score_x_weekend", "event_score_x_promo", "day_of_week",
    "is_weekend", "month", "day_of_month", "days_to_holiday", "days_since_holiday",
    "shop_total_lag_7", "trend_28d", "lag_1", "lag_7", "lag_14", "lag_28", "roll_mean_7",
    "roll_std_7", "roll_mean_14", "roll_std_14",
)
CATEGORICAL_FEATURES = ("item_id", "month", "day_of_week")

# inventory
Z_95 = 1.645
SERVICE_LEVEL_MIN = 1e-4
SERVICE_LEVEL_MAX = 0.9999
PRIORITY_MUST = "필수"
PRIORITY_RECOMMEND = "권장"
PRIORITY_SPARE = "여유"
MUST_THRESHOLD = 0.30
RECOMMEND_THRESHOLD = 0.70
NAIVE_FLAT_SIGMA_FACTOR = 1.15
NAIVE_TAIL_DAYS = 7
NAIVE_MIN_HISTORY_DAYS = 10

# stock view
DEFAULT_CATEGORY = "기타"
INVENTORY_ID_PREFIX = "INV-"
DEFAULT_MIN_STOCK = 10
DEFAULT_MAX_STOCK = 50
DEFAULT_DAILY_USAGE = 5
ALL_CATEGORIES = "전체"
NOT_SELECTED = "선택 안함"
EXPIRING_DAYS = 3
UNIT_SUFFIX = "개"

# reorder list
REORDER_COVER_DAYS = 14
URGENCY_HIGH_DAYS = 2
URGENCY_MEDIUM_DAYS = 5
NO_USAGE_DAYS_LEFT = 999

# accuracy
ACCURATE_AT = 90
WARNING_AT = 70
STABLE_AT = 85
WEEKLY_WARNING_BELOW = 88
VOLUME_SCORE_BASE = 80
VOLUME_SCORE_SLOPE = 1.4
VOLUME_SCORE_CAP = 95
VOLUME_MIN_QTY = 50

# weather
PTY_TEXT = {1: "비", 2: "진눈깨비(비/눈)", 3: "눈", 4: "소나기"}
PTY_TEXT_OTHER = "강수"
RAIN_TEXT = "비"
NO_RAIN_TEXT = "강수없음"
WEATHER_FULL_DAY_ROWS = 24
WEATHER_SNAPSHOT_TIME = "1400"
PROVINCE_CELLS = (
    ("서울", 61, 125), ("부산", 98, 76), ("인천", 55, 124), ("대구", 89, 90),
    ("광주", 58, 74), ("대전", 67, 100), ("울산", 102, 84), ("세종", 66, 103),
    ("경기", 60, 120), ("강원", 73, 134), ("충북", 69, 107), ("충남", 68, 100),
    ("전북", 63, 89), ("전남", 51, 67), ("경북", 87, 106), ("경남", 91, 77),
    ("제주", 52, 38),
)

# request tags: chosen weather / event tags and their weights in percent
TAG_WEIGHTS_PCT = (
    ("weather", "비", -10), ("weather", "눈", -15), ("weather", "우박", -30),
    ("weather", "안개", -5), ("weather", "폭염", 20), ("weather", "황사", -10),
    ("event", "지역 축제", 30), ("event", "스포츠 경기", 25), ("event", "콘서트", 20),
    ("event", "전시회", 10),
)
# free-text keyword rules: (pattern, label, weight in percent), in order
KEYWORD_RULES = (
    ("비|소나기|장마|강우", "소나기/비(-10%)", -10),
    ("눈|폭설|함박눈", "폭설/눈(-15%)", -15),
    ("폭염|더위|무더위", "폭염(+20%)", 20),
    ("축제|페스티벌|행사", "축제(+30%)", 30),
    ("콘서트|공연", "공연(+20%)", 20),
    ("우박|태풍", "태풍/악천후(-30%)", -30),
    ("소풍|운동회|체육대회|나들이|마라톤", "야외행사(+15%)", 15),
)
AUTO_DETECTED_PREFIX = "자동인식: "
IMPACT_UP = "수요 약 {}% 증가 예측"
IMPACT_DOWN = "수요 약 {}% 감소 예측"
IMPACT_NONE = "외생 변수 영향 없음 (평년 수준)"
# forecast grid
WEEKDAY_FACTOR = ((5, 1.3), (6, 1.4), (0, 0.9), (4, 1.1))   # (weekday Mon=0, factor)
MIN_DAY_FACTOR = 0.1
GRID_DEFAULT_BASE = 10.0
GRID_Q95_FACTOR = 1.5
GRID_PROTECTION_DAYS = 4
GRID_ORDER_OFFSET = 20
GRID_DAYS = (-7, 2)                 # inclusive offsets around the request date

# event impact score bands: (lower bound, points)
EVENT_SIZE_BANDS = ((3000, 25), (1500, 20), (700, 15), (300, 10), (100, 5))
EVENT_DISTANCE_BANDS = ((100, 25), (300, 20), (500, 15), (1000, 10), (2000, 5))  # upper bound m
EVENT_MAIN_FLOW_BONUS = 5
EVENT_DISTANCE_CAP = 25
EVENT_OVERLAP_BANDS = ((0.7, 20), (0.4, 15), (0.2, 10))     # >= bound; > 0 gives 5
EVENT_OVERLAP_ANY = 5
EVENT_FIT_POINTS = 20
EVENT_DWELL_BANDS = ((4, 10), (2, 7), (1, 4))               # >= hours; else 1
EVENT_DWELL_MIN = 1
# ------------------------------------------------------------ end fixed values
