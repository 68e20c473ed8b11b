"""Fixed values of the generators: time patterns, dimension and fact templates, currencies, industries, correlation presets."""

from __future__ import annotations

DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
US_HOLIDAYS = {(1, 1): "New Year's Day", (7, 4): "Independence Day", (12, 25): "Christmas Day", (12, 31): "New Year's Eve"}


def _months(*w: float) -> dict[int, float]:
    return dict(enumerate(w, 1))


def _hours(*w: float) -> dict[int, float]:
    return dict(enumerate(w))


def _week(*w: float) -> dict[str, float]:
    return dict(zip(DAYS, w, strict=True))


#: Time patterns; events are (name, rule, multiplier, days).
TIME_PATTERNS = {
    "retail_seasonal": {
        "category": "retail", "description": "Retail with holiday peaks and weekend boosts", "noise_std": 0.10,
        "monthly_weights": _months(0.85, 0.80, 0.90, 0.95, 1.00, 0.95, 0.90, 0.95, 1.00, 1.05, 1.40, 1.60),
        "weekly_weights": _week(0.85, 0.90, 0.95, 1.00, 1.15, 1.20, 0.95),
        "events": [
            ("Black Friday", "fourth_thursday_november+1", 3.5, 1), ("Cyber Monday", "fourth_thursday_november+4", 2.5, 1), ("Christmas Eve", "12-24", 2.0, 1),
            ("Boxing Day", "12-26", 1.8, 2), ("New Year Sale", "01-01", 1.5, 3), ("Valentine's Day", "02-14", 1.4, 1), ("Easter Weekend", "first_sunday_april", 1.3, 2),
            ("Mother's Day", "second_sunday_may", 1.4, 1), ("Father's Day", "third_sunday_june", 1.2, 1), ("Memorial Day Weekend", "last_monday_may", 1.3, 3),
            ("July 4th", "07-04", 1.3, 1), ("Labor Day Weekend", "first_monday_september", 1.3, 3),
        ],
    },
    "grocery_weekly": {
        "category": "retail", "description": "Weekly grocery shopping", "noise_std": 0.08,
        "monthly_weights": _months(1.05, 0.95, 1.00, 1.00, 1.05, 1.05, 1.10, 1.05, 0.95, 1.00, 1.15, 1.20),
        "weekly_weights": _week(0.75, 0.80, 0.85, 0.90, 1.10, 1.35, 1.25),
        "events": [("Super Bowl Sunday", "first_sunday_february", 1.5, 2), ("Thanksgiving Week", "fourth_thursday_november", 1.8, 3)],
    },
    "ecommerce_flash": {
        "category": "retail", "description": "Online sales with flash sales", "noise_std": 0.15,
        "monthly_weights": _months(0.90, 0.85, 0.95, 1.00, 1.00, 0.95, 1.10, 0.95, 1.00, 1.05, 1.50, 1.45),
        "weekly_weights": _week(1.10, 1.00, 0.95, 1.00, 0.90, 0.85, 1.15),
        "events": [("Prime Day", "07-15", 2.5, 2), ("Singles Day", "11-11", 2.0, 1)],
    },
    "luxury_retail": {
        "category": "retail", "description": "Luxury goods, driven by events", "noise_std": 0.12,
        "monthly_weights": _months(0.70, 0.95, 0.85, 0.90, 1.00, 1.00, 0.85, 0.90, 1.00, 1.00, 1.20, 1.70),
        "events": [("Valentine's Day", "02-14", 2.0, 1), ("Mother's Day", "second_sunday_may", 1.8, 1), ("Christmas", "12-20", 2.0, 5)],
    },
    "financial_quarterly": {
        "category": "financial", "description": "Spikes at the ends of quarters and of the year", "noise_std": 0.08,
        "quarterly_weights": {1: 0.90, 2: 0.95, 3: 1.05, 4: 1.10},
        "monthly_weights": _months(0.85, 0.90, 1.25, 0.85, 0.90, 1.25, 0.85, 0.90, 1.25, 0.90, 0.95, 1.30),
        "weekly_weights": _week(1.10, 1.05, 1.00, 0.95, 0.90, 0.0, 0.0),
    },
    "banking_transactions": {
        "category": "financial", "description": "Bank transactions with payroll cycles", "noise_std": 0.10,
        "monthly_weights": _months(0.95, 0.90, 1.00, 1.05, 1.00, 1.00, 0.95, 0.95, 1.00, 1.00, 1.05, 1.10),
        "weekly_weights": _week(1.15, 1.10, 1.00, 0.95, 1.20, 0.40, 0.20),
        "events": [("Tax Day", "04-15", 1.8, 3), ("Month End", "01-31", 1.3, 1)],
    },
    "investment_trading": {
        "category": "financial", "description": "Trading volumes", "noise_std": 0.15,
        "monthly_weights": _months(1.15, 0.95, 1.05, 1.00, 0.95, 0.90, 0.85, 0.85, 1.00, 1.10, 1.05, 0.90),
        "weekly_weights": _week(1.15, 1.00, 1.00, 0.95, 1.10, 0.0, 0.0),
        "events": [(f"Triple Witching {m.title()}", f"third_friday_{m}", 1.8, 1) for m in ("march", "june", "september", "december")],
    },
    "insurance_claims": {
        "category": "financial", "description": "Insurance claims", "noise_std": 0.12,
        "monthly_weights": _months(1.10, 1.05, 0.95, 1.00, 1.05, 1.15, 1.20, 1.15, 1.00, 1.00, 1.10, 1.15),
        "weekly_weights": _week(1.20, 1.00, 0.95, 0.95, 1.00, 0.90, 0.80),
    },
    "manufacturing_shift": {
        "category": "operational", "description": "Production in shifts", "noise_std": 0.05,
        "hourly_weights": _hours(0.0, 0.0, 0.0, 0.0, 0.0, 0.1, 0.3, 0.8, 1.0, 1.0, 1.0, 0.9, 0.7, 0.9, 1.0, 1.0, 0.9, 0.8, 0.6, 0.4, 0.3, 0.2, 0.1, 0.0),
        "weekly_weights": _week(1.0, 1.0, 1.0, 1.0, 0.9, 0.3, 0.0),
    },
    "logistics_shipping": {
        "category": "operational", "description": "Shipping volumes", "noise_std": 0.08,
        "monthly_weights": _months(0.85, 0.85, 0.95, 1.00, 1.05, 1.00, 0.95, 1.05, 1.10, 1.15, 1.35, 1.40),
        "weekly_weights": _week(0.95, 1.10, 1.15, 1.10, 0.90, 0.60, 0.20),
        "events": [("Black Friday Week", "fourth_thursday_november", 2.0, 7), ("Christmas Rush", "12-15", 1.8, 10)],
    },
    "healthcare_visits": {
        "category": "operational", "description": "Patient visits", "noise_std": 0.15,
        "monthly_weights": _months(1.20, 1.15, 1.05, 0.90, 0.85, 0.80, 0.75, 0.80, 0.95, 1.00, 1.10, 1.15),
        "weekly_weights": _week(1.30, 1.10, 1.00, 1.00, 0.90, 0.50, 0.20),
    },
    "call_center_volume": {
        "category": "operational", "description": "Calls to customer service", "noise_std": 0.12,
        "hourly_weights": _hours(0.05, 0.02, 0.01, 0.01, 0.02, 0.05, 0.15, 0.35, 0.65, 0.90, 1.00, 0.95, 0.75, 0.85, 0.90, 0.85, 0.75, 0.55, 0.35, 0.25, 0.15, 0.10, 0.08, 0.05),
        "monthly_weights": _months(1.20, 0.95, 1.00, 1.00, 0.95, 0.90, 0.90, 0.95, 1.00, 1.05, 1.10, 1.25),
        "weekly_weights": _week(1.30, 1.05, 1.00, 0.95, 0.90, 0.50, 0.30),
    },
    "energy_consumption": {
        "category": "operational", "description": "Energy consumption", "noise_std": 0.08,
        "hourly_weights": _hours(0.60, 0.55, 0.50, 0.50, 0.55, 0.65, 0.80, 0.95, 1.00, 1.00, 1.00, 1.05, 1.00, 1.00, 1.05, 1.10, 1.10, 1.15, 1.20, 1.15, 1.00, 0.85, 0.75, 0.65),
        "monthly_weights": _months(1.30, 1.25, 1.05, 0.85, 0.80, 0.95, 1.15, 1.20, 0.95, 0.85, 1.00, 1.25),
        "weekly_weights": _week(1.00, 1.00, 1.00, 1.00, 0.95, 0.80, 0.75),
    },
    "website_traffic": {
        "category": "operational", "description": "Website traffic", "noise_std": 0.15,
        "hourly_weights": _hours(0.30, 0.20, 0.15, 0.12, 0.15, 0.25, 0.45, 0.70, 0.90, 1.00, 1.05, 1.00, 0.85, 0.95, 1.00, 0.95, 0.90, 0.80, 0.70, 0.75, 0.85, 0.90, 0.75, 0.50),
        "weekly_weights": _week(1.10, 1.05, 1.00, 1.00, 0.90, 0.75, 0.85),
    },
    "ecommerce_daily": {
        "category": "retail", "description": "Online shops through the day", "noise_std": 0.12,
        "hourly_weights": _hours(0.2, 0.1, 0.1, 0.1, 0.1, 0.2, 0.4, 0.6, 0.8, 1.0, 1.1, 1.2, 1.3, 1.2, 1.1, 1.0, 0.9, 0.8, 0.9, 1.0, 1.2, 1.3, 1.0, 0.5),
        "weekly_weights": _week(1.1, 1.0, 0.95, 1.0, 0.9, 0.8, 1.15),
    },
    "healthcare_weekly": {
        "category": "operational", "description": "Health visits through the week", "noise_std": 0.15,
        "monthly_weights": _months(1.2, 1.1, 1.0, 0.9, 0.85, 0.80, 0.75, 0.80, 0.95, 1.0, 1.1, 1.15),
        "weekly_weights": _week(1.3, 1.1, 1.0, 1.0, 0.9, 0.5, 0.2),
    },
    "linear_growth": {"category": "general", "description": "Steady growth", "noise_std": 0.05, "trend": "linear", "slope": 0.001},
    "exponential_growth": {"category": "general", "description": "Compound growth", "noise_std": 0.08, "trend": "exponential", "rate": 0.0003},
}

#: Columns of the dimension templates (name: generator; ! marks unique ones).
DIMENSIONS = {
    "customer": (("customer_id", "!integer"), ("customer_name", "name"), ("email", "email"), ("phone", "phone"), ("city", "city"), ("state", "state"), ("country", "country"), ("segment", "segment")),
    "product": (("product_id", "!integer"), ("product_name", "product_name"), ("sku", "!sku"), ("category", "category"), ("unit_price", "decimal"), ("unit_cost", "decimal")),
    "geography": (("geography_id", "!integer"), ("city", "city"), ("state", "state"), ("country", "country"), ("region", "region"), ("postal_code", "zipcode")),
    "employee": (("employee_id", "!integer"), ("first_name", "first_name"), ("last_name", "last_name"), ("email", "email"), ("department", "department"), ("job_title", "job"), ("hire_date", "date")),
    "department": (("department_id", "!integer"), ("department_name", "!department"), ("cost_center", "string")),
    "account": (("account_id", "!integer"), ("account_code", "!string"), ("account_name", "string"), ("account_type", "account_type"), ("is_active", "boolean")),
    "supplier": (("supplier_id", "!integer"), ("supplier_name", "company"), ("contact_name", "name"), ("phone", "phone"), ("city", "city"), ("country", "country")),
    "warehouse": (("warehouse_id", "!integer"), ("warehouse_name", "string"), ("location", "city"), ("capacity", "integer"), ("region", "region")),
}
#: Pools of the value generators.
POOLS = {
    "category": ["Electronics", "Clothing", "Food", "Home", "Office", "Sports"],
    "department": ["Sales", "Marketing", "Engineering", "Finance", "HR", "Operations"],
    "region": ["North", "South", "East", "West", "Central"],
    "segment": ["Enterprise", "Mid-Market", "SMB", "Consumer"],
    "account_type": ["Asset", "Liability", "Equity", "Revenue", "Expense"],
    "edition": ["Pro", "Plus", "Basic", "Premium"],
    "country": ["United States", "Canada", "Mexico", "Brazil", "United Kingdom", "Germany", "France", "Spain", "Italy", "Japan", "India", "Australia"],
    "state": ["CA", "TX", "NY", "FL", "IL", "PA", "OH", "GA", "NC", "MI", "WA", "CO"],
    "job": ["Analyst", "Engineer", "Manager", "Director", "Consultant", "Accountant", "Designer", "Technician", "Planner", "Buyer"],
    "word": ["amber", "birch", "cobalt", "delta", "ember", "fjord", "grove", "harbor", "indigo", "juniper", "kestrel", "lumen", "maple", "nimbus", "onyx", "pebble"],
    "company_end": ["Group", "Ltd", "Partners", "Holdings", "Works"],
}

#: Measures (name, type, min, max, distribution) and attributes (name, values, weights) of the fact templates.
FACTS = {
    "sales": {
        "measures": [("quantity", "integer", 1, 100, "normal"), ("unit_price", "decimal", 5, 500, "lognormal"), ("discount_pct", "decimal", 0, 0.3, "exponential"), ("total_amount", "decimal", 10, 10000, "lognormal")],
        "attributes": [
            ("order_status", ["Pending", "Processing", "Shipped", "Delivered", "Cancelled"], [0.05, 0.10, 0.15, 0.65, 0.05]),
            ("payment_method", ["Credit Card", "Debit Card", "PayPal", "Bank Transfer", "Cash"], [0.40, 0.25, 0.20, 0.10, 0.05]),
            ("sales_channel", ["Online", "In-Store", "Phone", "Partner"], [0.50, 0.35, 0.10, 0.05]),
        ],
    },
    "finance": {
        "measures": [
            ("actual_amount", "decimal", -500000, 500000, "normal"), ("budget_amount", "decimal", 0, 600000, "normal"), ("forecast_amount", "decimal", 0, 550000, "normal"),
            ("prior_year_amount", "decimal", -450000, 450000, "normal"), ("committed_amount", "decimal", 0, 300000, "lognormal"), ("encumbered_amount", "decimal", 0, 200000, "exponential"),
            ("quantity", "decimal", 0, 10000, "lognormal"), ("unit_cost", "decimal", 0.01, 5000, "lognormal"), ("exchange_rate", "decimal", 0.5, 2.0, "uniform"),
        ],
        "attributes": [
            ("scenario", ["Actual", "Budget", "Forecast", "Plan"], [0.50, 0.25, 0.15, 0.10]),
            ("transaction_type", ["Revenue", "Expense", "Transfer", "Adjustment", "Accrual", "Deferral"], [0.30, 0.40, 0.10, 0.08, 0.07, 0.05]),
            ("entry_type", ["Journal Entry", "Invoice", "Payment", "Receipt", "Allocation", "Reclass"], [0.25, 0.25, 0.20, 0.15, 0.10, 0.05]),
            ("posting_status", ["Posted", "Pending", "Reversed", "Draft", "Approved"], [0.65, 0.12, 0.05, 0.08, 0.10]),
            ("currency_code", ["USD", "EUR", "GBP", "JPY", "CAD", "CHF", "AUD"], [0.45, 0.20, 0.10, 0.08, 0.07, 0.05, 0.05]),
            ("fiscal_period", [f"P{i:02d}" for i in range(1, 13)] + ["ADJ"], [0.08] * 12 + [0.04]),
            ("fiscal_year", ["FY2022", "FY2023", "FY2024", "FY2025"], [0.15, 0.25, 0.35, 0.25]),
            ("cost_center", ["CC100", "CC200", "CC300", "CC400", "CC500", "CC600"], [0.20, 0.18, 0.17, 0.16, 0.15, 0.14]),
            ("ledger_type", ["Primary", "Secondary", "Reporting", "Elimination"], [0.70, 0.15, 0.10, 0.05]),
            ("intercompany_flag", ["Y", "N"], [0.15, 0.85]),
            ("source_system", ["SAP", "Oracle", "Manual", "Interface", "Consolidation"], [0.40, 0.30, 0.10, 0.12, 0.08]),
        ],
    },
    "inventory": {
        "measures": [("quantity_on_hand", "integer", 0, 5000, "normal"), ("quantity_ordered", "integer", 0, 1000, "exponential"), ("reorder_point", "integer", 10, 500, "uniform")],
        "attributes": [
            ("stock_status", ["In Stock", "Low Stock", "Out of Stock", "Backordered"], [0.60, 0.20, 0.10, 0.10]),
            ("movement_type", ["Receipt", "Issue", "Transfer", "Adjustment", "Return"], [0.30, 0.35, 0.15, 0.10, 0.10]),
            ("storage_location", ["Warehouse A", "Warehouse B", "Distribution Center", "Store Floor"], [0.35, 0.30, 0.25, 0.10]),
        ],
    },
    "hr": {
        "measures": [("hours_worked", "decimal", 0, 60, "normal"), ("overtime_hours", "decimal", 0, 20, "exponential"), ("salary_amount", "decimal", 2000, 15000, "normal")],
        "attributes": [
            ("attendance_status", ["Present", "Absent", "Leave", "Work From Home", "Holiday"], [0.70, 0.05, 0.10, 0.10, 0.05]),
            ("pay_type", ["Regular", "Overtime", "Bonus", "Commission", "Adjustment"], [0.60, 0.15, 0.10, 0.10, 0.05]),
            ("shift", ["Day", "Evening", "Night", "Flexible"], [0.50, 0.20, 0.15, 0.15]),
        ],
    },
    "transactions": {
        "measures": [("amount", "decimal", 1, 5000, "lognormal"), ("fee", "decimal", 0, 50, "exponential"), ("net_amount", "decimal", 1, 5000, "lognormal")],
        "attributes": [
            ("transaction_status", ["Completed", "Pending", "Failed", "Refunded", "Disputed"], [0.75, 0.10, 0.05, 0.07, 0.03]),
            ("transaction_type", ["Purchase", "Refund", "Authorization", "Capture", "Void"], [0.70, 0.15, 0.05, 0.05, 0.05]),
            ("payment_processor", ["Stripe", "PayPal", "Square", "Adyen", "Internal"], [0.35, 0.30, 0.15, 0.15, 0.05]),
        ],
    },
}

#: Code, name, symbol, decimals, country, units for a US dollar, yearly volatility.
CURRENCIES = [
    ("USD", "US Dollar", "$", 2, "United States", 1.0, 0.0),
    ("EUR", "Euro", "€", 2, "European Union", 0.92, 0.08),
    ("GBP", "British Pound", "£", 2, "United Kingdom", 0.79, 0.10),
    ("JPY", "Japanese Yen", "¥", 0, "Japan", 149.5, 0.10),
    ("CHF", "Swiss Franc", "CHF", 2, "Switzerland", 0.88, 0.08),
    ("CAD", "Canadian Dollar", "C$", 2, "Canada", 1.36, 0.07),
    ("AUD", "Australian Dollar", "A$", 2, "Australia", 1.53, 0.11),
    ("NZD", "New Zealand Dollar", "NZ$", 2, "New Zealand", 1.64, 0.12),
    ("CNY", "Chinese Yuan", "¥", 2, "China", 7.24, 0.04),
    ("INR", "Indian Rupee", "₹", 2, "India", 83.2, 0.06),
    ("MXN", "Mexican Peso", "$", 2, "Mexico", 17.1, 0.13),
    ("BRL", "Brazilian Real", "R$", 2, "Brazil", 4.97, 0.16),
    ("KRW", "South Korean Won", "₩", 0, "South Korea", 1320.0, 0.09),
    ("SGD", "Singapore Dollar", "S$", 2, "Singapore", 1.34, 0.05),
    ("HKD", "Hong Kong Dollar", "HK$", 2, "Hong Kong", 7.82, 0.01),
    ("SEK", "Swedish Krona", "kr", 2, "Sweden", 10.5, 0.10),
    ("NOK", "Norwegian Krone", "kr", 2, "Norway", 10.7, 0.11),
    ("DKK", "Danish Krone", "kr", 2, "Denmark", 6.88, 0.02),
    ("ZAR", "South African Rand", "R", 2, "South Africa", 18.8, 0.16),
    ("RUB", "Russian Ruble", "₽", 2, "Russia", 91.5, 0.20),
    ("PLN", "Polish Zloty", "zł", 2, "Poland", 4.02, 0.10),
    ("TRY", "Turkish Lira", "₺", 2, "Turkey", 32.1, 0.25),
    ("THB", "Thai Baht", "฿", 2, "Thailand", 35.5, 0.07),
    ("IDR", "Indonesian Rupiah", "Rp", 0, "Indonesia", 15700.0, 0.08),
    ("MYR", "Malaysian Ringgit", "RM", 2, "Malaysia", 4.72, 0.06),
    ("PHP", "Philippine Peso", "₱", 2, "Philippines", 56.2, 0.07),
    ("CZK", "Czech Koruna", "Kč", 2, "Czech Republic", 22.9, 0.08),
    ("ILS", "Israeli Shekel", "₪", 2, "Israel", 3.75, 0.08),
    ("CLP", "Chilean Peso", "$", 0, "Chile", 890.0, 0.12),
    ("AED", "UAE Dirham", "د.إ", 2, "United Arab Emirates", 3.67, 0.01),
    ("SAR", "Saudi Riyal", "﷼", 2, "Saudi Arabia", 3.75, 0.01),
]
MAJOR_CURRENCIES = ("USD", "EUR", "GBP", "JPY", "CHF", "CAD", "AUD")

#: Star schemas of industries: dimensions (kind, rows, columns) and facts (kind, rows, measures, keys).
INDUSTRIES = {
    "retail": {
        "customer": ("customer", 5000, ("customer_id", "first_name", "last_name", "email", "segment", "registration_date")),
        "product": ("product", 1000, ("product_id", "product_name", "category", "subcategory", "brand", "unit_price", "unit_cost")),
        "store": ("geography", 50, ("store_id", "store_name", "city", "state", "country", "region")),
        "promotion": ("custom", 100, ("promotion_id", "promotion_name", "discount_type", "discount_value", "start_date", "end_date")),
        "facts": {
            "sales": ("sales", 500_000, ("quantity", "unit_price", "discount_amount", "total_amount", "cost_amount", "profit"), ("customer_id", "product_id", "store_id", "date_key")),
            "inventory": ("inventory", 50_000, ("quantity_on_hand", "quantity_on_order", "reorder_point", "days_of_supply"), ("product_id", "store_id", "date_key")),
        },
    },
    "healthcare": {
        "patient": ("custom", 10_000, ("patient_id", "first_name", "last_name", "date_of_birth", "gender", "blood_type", "insurance_type")),
        "provider": ("custom", 500, ("provider_id", "provider_name", "specialty", "department", "facility", "npi_number")),
        "diagnosis": ("custom", 1000, ("diagnosis_id", "icd_code", "diagnosis_name", "category", "severity")),
        "procedure": ("custom", 500, ("procedure_id", "cpt_code", "procedure_name", "category", "typical_duration_minutes")),
        "facts": {
            "encounters": ("transactions", 200_000, ("duration_minutes", "charge_amount", "payment_amount", "copay_amount"), ("patient_id", "provider_id", "diagnosis_id", "date_key")),
            "claims": ("finance", 150_000, ("billed_amount", "allowed_amount", "paid_amount", "patient_responsibility"), ("patient_id", "provider_id", "procedure_id", "date_key")),
        },
    },
    "manufacturing": {
        "machine": ("custom", 100, ("machine_id", "machine_name", "machine_type", "manufacturer", "install_date", "location")),
        "operator": ("employee", 200, ("operator_id", "first_name", "last_name", "shift", "skill_level", "hire_date")),
        "product": ("custom", 500, ("product_id", "product_name", "product_line", "specification", "unit_of_measure")),
        "shift": ("custom", 3, ("shift_id", "shift_name", "start_time", "end_time")),
        "facts": {
            "production": ("custom", 300_000, ("units_produced", "units_scrapped", "cycle_time_seconds", "setup_time_minutes", "downtime_minutes"), ("machine_id", "operator_id", "product_id", "shift_id", "date_key")),
            "quality": ("custom", 50_000, ("sample_size", "defects_found", "defect_rate", "rework_time_minutes"), ("machine_id", "product_id", "date_key")),
        },
    },
    "banking": {
        "customer": ("customer", 10_000, ("customer_id", "first_name", "last_name", "customer_type", "segment", "risk_rating", "relationship_start_date")),
        "account": ("custom", 20_000, ("account_id", "account_number", "account_type", "status", "open_date", "interest_rate")),
        "branch": ("geography", 100, ("branch_id", "branch_name", "city", "state", "region", "branch_type")),
        "transaction_type": ("custom", 20, ("transaction_type_id", "transaction_type_name", "category", "is_debit")),
        "facts": {
            "transactions": ("finance", 1_000_000, ("transaction_amount", "fee_amount", "running_balance"), ("customer_id", "account_id", "branch_id", "transaction_type_id", "date_key")),
            "account_balances": ("custom", 100_000, ("opening_balance", "closing_balance", "average_balance", "interest_earned"), ("account_id", "date_key")),
        },
    },
    "insurance": {
        "policyholder": ("customer", 15_000, ("policyholder_id", "first_name", "last_name", "date_of_birth", "gender", "occupation", "risk_class")),
        "policy": ("custom", 20_000, ("policy_id", "policy_number", "policy_type", "coverage_type", "effective_date", "expiration_date", "premium_amount")),
        "agent": ("employee", 200, ("agent_id", "first_name", "last_name", "agency", "license_state", "commission_rate")),
        "coverage": ("custom", 50, ("coverage_id", "coverage_name", "coverage_category", "deductible", "max_benefit")),
        "facts": {
            "claims": ("custom", 50_000, ("claim_amount", "approved_amount", "paid_amount", "deductible_applied", "processing_days"), ("policyholder_id", "policy_id", "coverage_id", "date_key")),
            "premiums": ("custom", 100_000, ("premium_amount", "commission_amount", "tax_amount", "net_premium"), ("policyholder_id", "policy_id", "agent_id", "date_key")),
        },
    },
    "telecom": {
        "subscriber": ("customer", 50_000, ("subscriber_id", "first_name", "last_name", "email", "account_type", "status", "activation_date")),
        "plan": ("custom", 30, ("plan_id", "plan_name", "plan_type", "monthly_fee", "data_limit_gb", "voice_minutes", "text_limit")),
        "device": ("custom", 200, ("device_id", "device_name", "manufacturer", "device_type", "release_date", "retail_price")),
        "tower": ("custom", 500, ("tower_id", "tower_name", "city", "state", "latitude", "longitude", "tower_type")),
        "facts": {
            "usage": ("custom", 500_000, ("data_mb", "voice_minutes", "text_count", "roaming_charges", "overage_charges"), ("subscriber_id", "plan_id", "tower_id", "date_key")),
            "billing": ("custom", 150_000, ("plan_charges", "usage_charges", "taxes", "total_amount", "payment_amount"), ("subscriber_id", "plan_id", "date_key")),
        },
    },
}

#: Correlation presets.
CORRELATIONS = {
    "sales_quantity_discount": {"type": "tiered", "source": ["quantity"], "target": "discount_rate", "tiers": [(0, 10, 0.0), (10, 25, 0.05), (25, 50, 0.10), (50, 100, 0.15), (100, None, 0.20)], "default": 0.0},
    "sales_total_calculation": {"type": "formula", "source": ["quantity", "unit_price", "discount_rate"], "target": "total_amount", "formula": "quantity * unit_price * (1 - discount_rate)", "round_to": 2},
    "region_shipping_cost": {
        "type": "categorical", "source": ["region"], "target": "shipping_cost",
        "distributions": {"North": {5.99: 0.3, 7.99: 0.5, 12.99: 0.2}, "South": {4.99: 0.4, 6.99: 0.4, 9.99: 0.2}, "East": {6.99: 0.3, 8.99: 0.4, 14.99: 0.3}, "West": {7.99: 0.3, 9.99: 0.4, 19.99: 0.3}},
        "default": {6.99: 0.5, 9.99: 0.5},
    },
    "customer_segment_discount": {
        "type": "categorical", "source": ["customer_segment"], "target": "loyalty_discount",
        "distributions": {"Consumer": {0.0: 0.6, 0.05: 0.3, 0.10: 0.1}, "Corporate": {0.05: 0.3, 0.10: 0.4, 0.15: 0.3}, "Home Office": {0.0: 0.4, 0.05: 0.4, 0.10: 0.2}},
    },
    "price_cost_correlation": {"type": "statistical", "source": ["unit_price"], "target": "unit_cost", "correlation": 0.85, "mean": 50, "std": 15, "min_value": 5, "round_to": 2},
}
