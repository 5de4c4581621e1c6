"""Thresholds, names and texts that results must show as given."""

from datetime import date

# Cleaning
CANCEL_PREFIX = "C"
MIN_CODE_LENGTH = 5
OUTLIER_QUANTITIES = (80995, 74215)
GUEST_KEY = "Guest"

# Observed days, and the months and cohort that the insights quote
FIRST_DAY = date(2010, 12, 1)
LAST_DAY = date(2011, 12, 9)
BASE_MONTH = "2011-01"
PEAK_MONTH = "2011-11"
LAST_MONTH = "2011-12"
LONG_COHORT = "2010-12"
LONG_OFFSET = 11
MAX_MONTH_DIFF = 11

# Funnel steps: description and label on the sheet
STEP_DESCRIPTIONS = {
    "raw": "원본 거래 라인",
    "remove_cancel_invoice": "InvoiceNo가 {prefix}로 시작하는 취소 거래 제거",
    "remove_short_stock_code": "StockCode {length}자 미만 특수 처리 코드 제거",
    "remove_non_positive_quantity": "Quantity 0 이하 제거",
    "remove_non_positive_unit_price": "UnitPrice 0 이하 제거",
    "remove_quantity_outliers": "대량 이상치 Quantity {outliers} 제거",
}
STEP_LABELS = {
    "raw": "원본",
    "remove_cancel_invoice": "취소 거래 제거",
    "remove_short_stock_code": "특수 코드 제거",
    "remove_non_positive_quantity": "비정상 수량 제거",
    "remove_non_positive_unit_price": "비정상 단가 제거",
    "remove_quantity_outliers": "대량 이상치 제거",
}

# Sheet columns in order, with their display headers
MONTHLY_HEADERS = {
    "order_month": "거래월",
    "avg_daily_revenue": "일평균 매출",
    "avg_daily_customers": "일평균 고객 수",
    "avg_daily_orders": "일평균 주문 수",
    "revenue_mom_pct": "매출 전월 대비(%)",
    "customers_mom_pct": "고객 수 전월 대비(%)",
    "orders_mom_pct": "주문 수 전월 대비(%)",
}
GUEST_HEADERS = {
    "order_month": "거래월",
    "guest_order_share_pct": "비회원 주문 비중(%)",
    "guest_revenue_share_pct": "비회원 매출 비중(%)",
    "guest_avg_revenue_per_order": "비회원 주문당 평균 매출",
    "guest_orders": "비회원 주문 수",
    "total_orders": "전체 주문 수",
}
QUALITY_HEADERS = {
    "step_label": "단계",
    "description": "전처리 규칙",
    "rows_remaining": "남은 행 수",
    "rows_removed_from_previous": "제거된 행 수",
    "rows_remaining_pct": "잔존율(%)",
}
RETENTION_HEADERS = {"cohort_month": "코호트", "new_users": "신규 고객 수"}
RETENTION_CELL_HEADER = "+{offset}개월"

# Lower bounds of the retention bands, in percent
RETENTION_BANDS = [(35.0, "high"), (25.0, "good"), (18.0, "fair")]
LOWEST_BAND = "low"

# Headline cards: label and note
CARDS = [
    ("정제 후 매출", "전처리 기준 적용"),
    ("{month}월 일평균 매출", "Q4 수요 피크"),
    ("{month}월 비회원 매출 비중", "주문 비중은 {share}"),
    ("+1개월 리텐션", "초기 이탈 관리 필요"),
]
CONSISTENCY_SENTENCE = (
    "일관성 확인: 대량 이상치 Quantity {quantity}를 제거한 뒤 {year}년 {month}월 일평균 매출은 {with_rule}이다. "
    "해당 필터를 적용하지 않으면 {without_rule}로 계산된다."
)

# Texts that stand for a missing value in a CSV field, in any column.
MISSING_VALUES = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)
