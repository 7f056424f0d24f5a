"""Ten seed promotions; texts abridged to what the checks look at."""

FIELDS = "id BIGINT, company STRING, category STRING, threat_level STRING, period STRING, benefit_value STRING, title STRING, url STRING"
ROWS = [
    (1, "신한카드", "식음료", "High", "2026.02.01~2026.03.31", "5,000원", "커피 할인", "https://a.example.com/event/detail/1"),
    (2, "삼성카드", "여행", "High", "2026.02.05~2026.04.30", "최대 30만원", "항공 캐시백", "https://a.example.com/event/detail/2"),
    (3, "현대카드", "쇼핑", "Mid", "2026.02.01~2026.02.28", "10% (최대 1만원)", "쇼핑 할인", "https://a.example.com/event/detail/3"),
    (4, "KB국민카드", "생활", "Mid", "2026.02.01~2026.03.31", "3,000원", "생활요금", "https://a.example.com/event/detail/4"),
    (5, "신한카드", "식음료", "High", "2026.02.05~2026.02.29", "20,000원", "배달 할인", "https://a.example.com/event/detail/5"),
    (6, "삼성카드", "교통", "Mid", "2026.02.01~2026.12.31", "리터당 100원 (월 최대 5,000원)", "주유 할인", "https://a.example.com/event/detail/6"),
    (7, "현대카드", "문화", "Low", "2026.02.01~2026.06.30", "영화 1매 무료", "영화", "https://a.example.com/event/detail/7"),
    (8, "KB국민카드", "쇼핑", "High", "2026.02.01~2026.02.28", "7% (최대 3만원)", "마트 할인", "https://a.example.com/event/detail/8"),
    (9, "신한카드", "식음료", "Mid", "2026.02.05~2026.03.31", "5,000원", "카페 할인", "https://a.example.com/event/detail/9"),
    (10, "삼성카드", "통신", "High", "2026.02.01~2026.12.31", "50% (최대 1만원)", "구독 할인", "https://a.example.com/event/detail/10"),
]
