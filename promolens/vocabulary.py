"""Keyword lists, markers and rule tables.

Everything below is a fixed value of the promotion domain (Korean card
promotions). Each list is a parameter: build another ``Vocabulary`` to run the
same operators on another market or language.
"""

from __future__ import annotations

from dataclasses import dataclass, field

Words = tuple[str, ...]
Rules = tuple[tuple[str, Words], ...]

# ---- fixed values: empty markers and record-level lists -------------------
EMPTY_MARKERS: Words = (
    "", "정보 없음", "정보없음", "제목 없음", "상세 페이지 참조", "-", " / ", "/",
)
EMPTY_SUBSTRINGS: Words = ("정보 없음", "정보없음")
NO_INFO = "정보 없음"
SEE_DETAIL = "상세 페이지 참조"
NOT_FOUND_MARKER = "조회 결과가 없습니다"
UNKNOWN_COMPANY = "기타"
UNKNOWN_CATEGORY = "미분류"

TITLE_NOISE: Words = ("진행중 이벤트", "이벤트", "혜택", "상세", "본문 바로가기")
HIDDEN_TITLE_PREFIXES: Words = ("이벤트에 응모되었습니다", "이벤트에 응모 되었습니다")
HIDDEN_TITLE_PAIR: Words = ("마이홈 앱의", "자산 연결")
DROPPED_QUERY_KEYS: Words = (
    "utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term",
    "fbclid", "gclid", "vst_clck_nm", "vst_page_nm",
)
DROPPED_WHEN_BLANK = "searchWord"

# ---- fixed values: first-match classification ------------------------------
CATEGORY_RULES: Rules = (
    ("여행", ("여행", "호텔", "항공", "리조트", "해외", "마일리지")),
    ("쇼핑", ("쇼핑", "백화점", "마트", "온라인", "쿠팡", "11번가")),
    ("식음료", ("식사", "레스토랑", "다이닝", "스타벅스", "카페", "배달", "음식")),
    ("교통", ("자동차", "주유", "차량", "하이패스", "교통")),
    ("문화", ("영화", "공연", "문화", "CGV", "도서", "OTT")),
    ("금융", ("금리", "대출", "할부", "금융", "적금", "예금")),
    ("통신", ("통신", "넷플릭스", "유튜브", "구독", "멜론")),
)
CATEGORY_DEFAULT = "생활"
LEGACY_CATEGORY_RULES: Rules = (
    ("여행", ("여행", "호텔", "항공", "리조트")),
    ("쇼핑", ("쇼핑", "할인", "백화점", "마트")),
    ("식음료", ("식사", "레스토랑", "다이닝", "스타벅스", "카페")),
    ("교통", ("자동차", "보험", "주유", "차량")),
    ("문화", ("영화", "공연", "문화", "CGV")),
    ("금융", ("금리", "대출", "할부", "금융")),
    ("통신", ("통신", "넷플릭스", "유튜브", "구독")),
)
LEGACY_CATEGORY_DEFAULT = "기타"
THREAT_RULES: Rules = (
    ("High", ("10만원", "20만원", "30만원", "50만원", "100만원", "최대", "프리미엄", "VIP")),
    ("Mid", ("1만원", "2만원", "3만원", "5만원", "5천원", "캐시백", "할인")),
)
LEGACY_THREAT_RULES: Rules = (
    ("High", ("10만원", "20만원", "30만원", "최대", "프리미엄")),
    ("Mid", ("1만원", "2만원", "3만원", "5천원")),
)
THREAT_DEFAULT = "Low"
THREAT_LEVELS: Words = ("High", "Mid", "Low")
BENEFIT_TYPE_RULES: Rules = (
    ("할인", ("할인",)),
    ("캐시백", ("캐시백",)),
    ("포인트적립", ("포인트", "적립")),
    ("무이자할부", ("무이자", "할부")),
    ("사은품", ("증정", "무료")),
)
BENEFIT_TYPE_DEFAULT = "기타"

# ---- fixed values: text structuring ----------------------------------------
HEADER_WORDS: Words = (
    "삼성카드", "삼성 카드", "samsungcard", "Samsung",
    "신한카드", "신한 카드", "shinhancard", "Shinhan",
    "현대카드", "현대 카드", "hyundaicard", "Hyundai",
    "KB국민카드", "KB 국민카드", "KB카드", "kbcard",
    "로그인", "마이페이지", "이벤트 목록", "전체메뉴", "고객센터",
    "회원가입", "빠른메뉴", "사이트맵",
)
NOTIFICATION_PREFIXES: Words = (
    "이벤트에 응모되었습니다", "이벤트에 응모 되었습니다", "이벤트에 응모됐습니다",
    "이벤트 참여가 완료되었습니다", "응모가 완료되었습니다",
    "이미 참여하셨습니다", "이미 응모하셨습니다",
)
NOISE_WORDS: Words = (
    "개인(신용)정보", "개인정보", "고유식별정보", "수집·이용", "수집이용", "수집 이용",
    "수집·이용 목적", "제3자 제공", "동의를 거부할", "주민등록번호", "개인정보처리방침",
    "신용정보", "법정대리인", "동의하지 않으실 경우", "소득세법", "과세 처리", "과세처리",
    "법령", "보유기간", "파기",
)
NOISE_RESCUE_WORDS: Words = (
    "혜택", "할인", "캐시백", "적립", "무이자", "청구할인", "즉시할인",
    "참여방법", "이벤트 기간", "대상카드",
)
NOISE_ALWAYS_WORDS: Words = ("개인정보", "동의")
MENU_WORDS: Words = (
    "로그인", "회원가입", "전체메뉴", "고객센터", "마이페이지", "개인사업자", "개인정보처리방침",
)
LINE_MARKERS: Words = ("·", "•", "※", "|")
SECTION_RULES: Rules = (
    ("혜택_상세", ("혜택", "할인", "캐시백", "적립", "포인트", "무료", "증정", "할부", "무이자",
                "리워드", "보너스", "청구할인", "즉시할인")),
    ("참여방법", ("참여", "응모", "신청", "등록", "접수", "가입", "다운로드", "설치", "앱",
               "온라인", "오프라인", "방법", "절차", "결제")),
    ("유의사항", ("유의", "주의", "안내", "필수", "반드시", "확인", "주의사항", "필수사항", "고지", "참고")),
    ("제한사항", ("제한", "제외", "불가", "불가능", "한도", "최대", "최소", "월", "1회", "횟수",
               "선착순", "제한사항")),
    ("파트너십", ("제휴", "파트너", "협력", "브랜드", "스타벅스", "CGV", "롯데", "신세계", "이마트",
               "올리브영", "GS25", "CU", "배달의민족", "요기요")),
    ("마케팅_메시지", ("특별", "프리미엄", "VIP", "신규", "첫", "한정", "오직", "단독", "이벤트",
                   "프로모션", "웰컴", "한시적")),
    ("타겟_고객", ("신규", "기존", "VIP", "프리미엄", "일반", "전체", "20대", "30대", "40대",
                "고객", "회원", "대상카드", "대상 카드")),
)
SECTION_HINTS: tuple[tuple[str, int, Words], ...] = (
    ("유의사항", 2, ("유의", "주의", "반드시", "필수")),
    ("제한사항", 2, ("제한", "제외", "불가", "한도", "최대", "최소", "월", "횟수", "선착순")),
    ("참여방법", 2, ("참여", "응모", "신청", "등록", "방법")),
    ("타겟_고객", 1, ("대상", "회원", "고객", "카드")),
)
TITLE_PREFERRED_WORDS: Words = ("혜택", "할인", "캐시백", "프로모션", "할부", "등록금", "자동차")
TITLE_BRAND_SUFFIXES: Words = (
    " | 삼성카드", " | Samsung", "- 삼성카드", "- Samsung",
    " | 신한카드", " | Shinhan", "- 신한카드", "- Shinhan",
    " | 현대카드", " | Hyundai", "- 현대카드", "- Hyundai",
    " | KB국민카드", " | KB카드", "- KB국민카드", "- KB카드",
    " :: 삼성카드", " :: 신한카드", " :: 현대카드", " :: KB국민카드",
)
PERIOD_LABELS: Words = ("기간", "이벤트 기간", "진행기간", "응모기간", "이용기간")
TARGET_LABELS: Words = ("대상카드", "대상 카드", "해당카드", "적용카드", "대상 회원", "대상 고객")
TARGET_ELEMENT_LABELS: Words = ("대상카드", "해당카드", "적용카드", "대상 카드")
SITE_DOMAINS: Words = ("samsungcard.com", "shinhancard.com", "hyundaicard.com", "kbcard.com")
BAD_TITLE_WORDS: Words = (
    "삼성카드", "삼성 카드", "samsungcard", "samsung card", "Samsung", "SAMSUNG",
    "이벤트에 응모되었습니다", "이벤트에 응모 되었습니다",
)
BAD_TITLE_PREFIXES: Words = (
    "이벤트에 응모되었습니다", "이벤트에 응모 되었습니다", "이벤트에 응모됐습니다", "이벤트에 응모 됐습니다",
)
DETAIL_HEADER_NOISE: Words = ("삼성카드", "삼성 카드", "로그인", "마이페이지", "이벤트 목록")
DETAIL_JUNK_TITLES: Words = (
    "새로워진삼성카드", "앱카드 앱에서응모", "앱에서 응모해 보세요", "앱에서응모해 보세요",
)
DETAIL_TITLE_SUFFIXES: Words = (" | 삼성카드", "- 삼성카드")
BLOCK_TITLE_WORDS: Words = ("이벤트", "혜택")

# ---- fixed values: scoring and tagging --------------------------------------
BENEFIT_LEVELS: Words = ("높음", "중상", "보통", "낮음")
BENEFIT_SCORES: tuple[tuple[str, float], ...] = (("높음", 4.0), ("중상", 3.0), ("보통", 2.0), ("낮음", 1.0))
LEVEL_KEEP_WORDS: Words = ("캐시백", "무이자", "할부", "적립", "청구할인")
VIP_WORDS: Words = ("VIP", "프리미엄", "우수회원")
TARGET_SIGNALS: Words = (
    "신규", "기존", "VIP", "프리미엄", "회원", "고객", "직장인", "대학생", "법인", "개인",
    "대상카드", "대상 카드",
)
BROAD_TARGET_WORDS: Words = ("전체", "전 고객", "전회원")
STRATEGY_RULES: Rules = (
    ("신규 고객 유치", ("신규", "첫", "웰컴", "처음")),
    ("기존 고객 리텐션", ("기존", "재이용", "재구매", "재참여")),
    ("한정/희소성 프로모션", ("한정", "선착순", "마감", "기간한정", "월", "1회", "한도", "최대")),
    ("참여 유도형 캠페인", ("응모", "추첨", "참여", "등록", "신청")),
    ("디지털 채널 전환", ("앱", "온라인", "간편결제", "KB Pay", "삼성카드 앱", "신한SOL")),
)
OBJECTIVE_RULES: Rules = (
    ("신규유치", ("신규", "첫", "웰컴", "가입")),
    ("리텐션", ("기존", "재이용", "재구매")),
    ("객단가증대", ("최대", "이상", "결제금액")),
    ("디지털전환", ("앱", "온라인", "디지털", "간편결제", "Pay")),
    ("제휴확장", ("제휴", "파트너", "스타벅스", "CGV", "배달")),
    ("브랜드강화", ("프리미엄", "VIP", "브랜드", "한정")),
)
TARGET_TAGS: Words = ("신규", "기존", "VIP", "프리미엄", "20대", "30대", "40대", "전연령", "법인")
TARGET_TAG_DEFAULT = "전연령"
CHANNEL_RULES: Rules = (
    ("앱", ("앱", "App", "APP")),
    ("웹", ("온라인", "웹", "사이트")),
    ("오프라인", ("오프라인", "매장", "점포")),
    ("간편결제", ("간편결제", "Pay", "페이")),
)
HIGH_VALUE_WORDS: Words = (
    "자동차", "오토", "여행", "항공", "호텔", "렌터카", "해외", "프리미엄", "골프", "할부", "무이자",
)
RECURRING_WORDS: Words = (
    "정기", "자동이체", "생활요금", "보험", "통신", "구독", "멤버십", "리텐션", "재이용", "재구매", "매월",
)
REPEAT_WORDS: Words = ("상시", "매월", "매주", "정기", "시즌", "연장", "재오픈", "상설")
RECURRING_HINT_WORDS: Words = ("리텐", "정기", "구독", "생활요금", "보험", "통신")
REPEAT_HINT_WORDS: Words = ("상시", "매월", "반복", "정기", "연장")
FIVE_LEVELS: tuple[tuple[float, str], ...] = (
    (85.0, "매우 높음"), (65.0, "높음"), (45.0, "중간"), (25.0, "낮음"),
)
FIVE_LEVEL_LOWEST = "매우 낮음"
FIVE_LEVEL_DEFAULT = "중간"
DIMENSION_METRICS: Words = (
    "고가 소비 비중(자동차·여행·할부)",
    "반복·계약 소비 비중(생활요금·보험·리텐션)",
    "카테고리 분산도(소비+관계 전체)",
    "이벤트 반복성(월/상시 구조)",
)
COMMON_PHRASES: Words = (
    "최소 결제", "선착순", "캐시백", "할인", "무이자", "포인트", "리워드", "적립",
    "월 한도", "자동이체", "전월 실적",
)
COMPANY_ORDER: Words = ("신한카드", "KB국민카드", "삼성카드", "현대카드")

# ---- fixed values: capture, link and search filters --------------------------
CAPTURE_URL_WORDS: Words = ("event", "list", "benefit", "promotion", "promo", "card", "data", "info")
CAPTURE_EXCLUDED_WORDS: Words = ("tracking", "analytics", "mpulse", "log", "metric", "stat")
CAPTURE_INDICATORS: Words = ("title", "name", "제목", "이벤트", "event", "benefit", "혜택")
LINK_HREF_WORDS: Words = (
    "event", "Event", "EVENT", "이벤트", "benefit", "promotion", "detail", "view", "info",
)
LINK_TEXT_WORDS: Words = ("이벤트", "프로모션", "할인", "혜택")
SEARCH_URL_WORDS: Words = ("event", "benefit")


@dataclass(frozen=True)
class Vocabulary:
    empty_markers: Words = EMPTY_MARKERS
    empty_substrings: Words = EMPTY_SUBSTRINGS
    title_noise: Words = TITLE_NOISE
    hidden_title_prefixes: Words = HIDDEN_TITLE_PREFIXES
    hidden_title_pair: Words = HIDDEN_TITLE_PAIR
    dropped_query_keys: Words = DROPPED_QUERY_KEYS
    dropped_when_blank: str = DROPPED_WHEN_BLANK
    category_rules: Rules = CATEGORY_RULES
    category_default: str = CATEGORY_DEFAULT
    threat_rules: Rules = THREAT_RULES
    threat_default: str = THREAT_DEFAULT
    benefit_type_rules: Rules = BENEFIT_TYPE_RULES
    benefit_type_default: str = BENEFIT_TYPE_DEFAULT
    header_words: Words = HEADER_WORDS
    notification_prefixes: Words = NOTIFICATION_PREFIXES
    noise_words: Words = NOISE_WORDS
    noise_rescue_words: Words = NOISE_RESCUE_WORDS
    noise_always_words: Words = NOISE_ALWAYS_WORDS
    menu_words: Words = MENU_WORDS
    line_markers: Words = LINE_MARKERS
    section_rules: Rules = SECTION_RULES
    section_hints: tuple[tuple[str, int, Words], ...] = SECTION_HINTS
    benefit_section: str = "혜택_상세"
    condition_sections: Words = ("참여방법", "유의사항", "제한사항")
    target_section: str = "타겟_고객"
    partner_section: str = "파트너십"
    title_preferred_words: Words = TITLE_PREFERRED_WORDS
    title_brand_suffixes: Words = TITLE_BRAND_SUFFIXES
    period_labels: Words = PERIOD_LABELS
    target_labels: Words = TARGET_LABELS
    target_element_labels: Words = TARGET_ELEMENT_LABELS
    site_domains: Words = SITE_DOMAINS
    company_order: Words = COMPANY_ORDER
    objective_rules: Rules = OBJECTIVE_RULES
    target_tags: Words = TARGET_TAGS
    channel_rules: Rules = CHANNEL_RULES
    link_href_words: Words = LINK_HREF_WORDS
    link_text_words: Words = LINK_TEXT_WORDS
    capture_url_words: Words = CAPTURE_URL_WORDS
    capture_excluded_words: Words = CAPTURE_EXCLUDED_WORDS
    capture_indicators: Words = CAPTURE_INDICATORS
    search_url_words: Words = SEARCH_URL_WORDS
    common_phrases: Words = COMMON_PHRASES
    extra: dict = field(default_factory=dict)

    @property
    def section_names(self) -> Words:
        return tuple(name for name, _ in self.section_rules)
