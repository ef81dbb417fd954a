"""Column names, code values and rule tables of the survey data model.

Everything below the "FIXED VALUES" marker is data, not logic: these are the
values a result must use to agree with the survey forms and the published
planning rules (exact Arabic code points, no normalisation). The operators in
``caseload.operators`` compile these tables into Spark column expressions, so
a caller can pass their own tables (local rates, other weights) instead.
"""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------------------
# FIXED VALUES — survey column names, code values and planning rules.
# ---------------------------------------------------------------------------


class MainCols:
    ID = "_id"
    GOVERNORATE = "المحافظة"
    DISTRICT = "المنطقة الإدارية"
    SUB_DISTRICT = "المنطقة الفرعية"
    VILLAGE = "اسم القرية"
    DISPLACEMENT_TYPE = "طبيعة العائلة"
    HOUSING_TYPE = "طبيعة السكن"
    FAMILY_SIZE = "عدد أفراد العائلة الفعلي"
    DEPENDENTS = "عدد الأفراد المعالين"
    BREADWINNERS = "عدد الأفراد المعيلين"
    ACCESS_TYPE = "طبيعة الوصول"
    SURVEY_DATE = "تاريخ النشاط"


class MemberCols:
    FAMILY_ID = "_submission__id"
    IS_HOH = "هل هذا الشخص هو رب الأسرة"
    MARITAL_STATUS = "الحالة الاجتماعية"
    GENDER = "الجنس"
    INDIVIDUAL_STATUS = "حالة الفرد"
    OCCUPATION = "occupation_bucket"
    BIRTH_YEAR = "birth_year"
    V_IMMEDIATE_HEALTH = "نقاط الضعف/حالة صحية تطلب تدخل فوري"
    V_CHRONIC_DISEASE = "نقاط الضعف/مرض مزمن"
    V_MENTAL_DISABILITY = "نقاط الضعف/إعاقة عقلية"
    V_PHYSICAL_DISABILITY = "نقاط الضعف/إعاقة جسدية"
    V_SPEECH_IMPAIRMENT = "نقاط الضعف/خلل في النطق"
    V_HEARING_IMPAIRMENT = "نقاط الضعف/خلل في السمع"
    V_VISION_IMPAIRMENT = "نقاط الضعف/خلل في الرؤية"
    V_CHILD_DROPOUT = "نقاط الضعف/طفل متسرب من المدرسة"
    V_FEMALE_HOH = "نقاط الضعف/امرأة ربة اسرة"
    # raw (pre-anonymisation) free-text columns
    OCCUPATION_TEXT = "العمل الحالي"
    OCCUPATION_TEXT_ALT = "العمل الحالي (الرجاء التحديد)"
    DATE_OF_BIRTH = "تاريخ الميلاد"
    DATE_OF_BIRTH_ALT = "date_of_birth"


class DamageCols:
    FAMILY_ID = "_submission__id"
    CATEGORY = "فئة الضرر"
    CLASSIFICATION = "تصنيف الضرر"
    QUANTITY = "الكمية المرتبطة بالضرر"


class NeedsCols:
    FAMILY_ID = "_submission__id"
    PROGRAM = "البرنامج (التصنيف الأول)"
    CLASSIFICATION = "تصنيف الاحتياج (التصنيف الثاني)"
    QUANTITY = "الكمية"
    SERVICE_RECEIVED = "هل حصلت العائلة (أو الفرد) على الخدمة"


YES = "نعم"
NO = "لا"
FEMALE = "أنثى"
MALE = "ذكر"

DISPLACED_TYPES = ("نازح داخلي", "نازح عائد (كان في منطقة أخرى داخل سوريا)", "لاجئ عائد (من خارج القطر)")
HOST_COMMUNITY = "مجتمع مضيف"
HOUSING_OWN = "ملك"
HOUSING_RENTING = "أجار"
HOUSING_HOSTED = "أستضافة"
HOUSING_HOMELESS = "لا يوجد مسكن"
HOUSING_OTHER = "أخرى"

WIDOW_MARITAL = ("منفصل/ة", "مطلق/ة")
MARRIED = "متزوج/ة"
SINGLE = "أعزب/عزباء"
ORPHAN_STATUS = ("متوفي", "مفقود")
PRESENT = "موجود"

BABY_NEEDS = ("حليب أطفال", "حفاضات أطفال", "مكملات غذائية للرضع")
PROGRAM_FINANCIAL = "احتياجات مالية أو سبل العيش"
PROGRAM_MEDICAL = "احتياجات طبية أو صحية"
PROGRAM_FOOD = "احتياجات غذائية"
PROGRAM_LEGAL = "قانوني"
PROGRAM_EDUCATION = "التعليم"
NEED_BLANKETS = "بطانيات"

DAMAGE_CATEGORIES = ("أضرار في الممتلكات", "أضرار في الثروة الزراعية", "أضرار في الثروة الحيوانية")

DISABILITY_FLAGS = (
    MemberCols.V_MENTAL_DISABILITY,
    MemberCols.V_PHYSICAL_DISABILITY,
    MemberCols.V_SPEECH_IMPAIRMENT,
    MemberCols.V_HEARING_IMPAIRMENT,
    MemberCols.V_VISION_IMPAIRMENT,
)

# Main columns removed from the case table once their values were copied.
MAIN_DROP_COLS = (
    MainCols.DISPLACEMENT_TYPE, MainCols.HOUSING_TYPE,
    MainCols.GOVERNORATE, MainCols.DISTRICT,
    MainCols.SUB_DISTRICT, MainCols.VILLAGE,
    MainCols.BREADWINNERS, MainCols.DEPENDENTS,
    MainCols.SURVEY_DATE, MainCols.FAMILY_SIZE,
    MainCols.ACCESS_TYPE,
)

SOURCE_FILE = "kobo_import"
SOURCE_SHEET = ""
MANUAL_SOURCE_FILE = "manual_entry"
MANUAL_SOURCE_SHEET = "log_entry"
UNKNOWN_CITY = "Unknown"

# Signal weights of the priority score, in declared order.
WEIGHTS = (
    ("is_homeless", 40),
    ("is_orphan_family", 30),
    ("is_widow", 25),
    ("is_unemployed", 25),
    ("is_displaced", 20),
    ("is_pregnant", 20),
    ("has_medical", 20),
    ("has_disability", 15),
    ("is_renting", 10),
)
# Family-size bonus on the truncated size: (minimum size, bonus), first match wins.
SIZE_BONUS = ((7, 15), (5, 10), (3, 5))
# Tier thresholds: (minimum score, tier), first match wins; otherwise LOW.
TIERS = ((80, "CRITICAL"), (50, "HIGH"), (25, "MEDIUM"))
LOW_TIER = "LOW"
TIER_ORDER = ("CRITICAL", "HIGH", "MEDIUM", "LOW")
MAX_SCORE = 210

SIGNALS = (
    "is_widow", "is_orphan_family", "is_displaced", "is_homeless", "is_renting",
    "is_unemployed", "has_medical", "has_disability", "is_pregnant", "has_damage",
    "service_received",
)

SIGNAL_LABELS = (
    ("is_widow", "Widow"),
    ("is_orphan_family", "Orphans"),
    ("is_displaced", "Displaced"),
    ("has_medical", "Medical"),
    ("has_disability", "Disability"),
    ("is_unemployed", "No Income"),
    ("is_homeless", "Homeless"),
    ("is_renting", "Renting"),
    ("is_pregnant", "Pregnant"),
)

DISPLAY_COLS = (
    "family_num", "priority_tier", "priority_score", "family_size",
    "city", "governorate", "displacement_type", "housing_type",
    "need_type", "is_widow", "is_orphan_family", "is_displaced",
    "has_medical", "is_unemployed", "has_disability",
)

# General needs rules: (signal or None for every family, item, category, urgency).
NEED_RULES = (
    (None, "Monthly food basket", "food", "high"),
    ("is_widow", "Women's hygiene kit", "hygiene", "high"),
    ("is_orphan_family", "Women's hygiene kit", "hygiene", "high"),
    ("is_displaced", "Blankets & bedding", "shelter", "critical"),
    ("is_homeless", "Blankets & bedding", "shelter", "critical"),
    ("is_homeless", "Emergency shelter referral", "shelter", "critical"),
    ("is_renting", "Rental financial assistance", "financial", "high"),
    ("has_medical", "Medication & treatment support", "medical", "critical"),
    ("has_disability", "Disability aid & rehab", "medical", "high"),
    ("is_pregnant", "Prenatal care & supplies", "medical", "critical"),
    ("is_unemployed", "Livelihood / income support", "financial", "high"),
    ("is_displaced", "Household essentials kit", "other", "high"),
    ("is_orphan_family", "School supplies for orphans", "education", "medium"),
    ("has_medical", "Psychosocial support", "psychosocial", "medium"),
)
URGENCY_RANK = (("critical", 0), ("high", 1), ("medium", 2))
URGENCY_ORDER = ("critical", "high", "medium")

CATEGORY_ICON = (
    ("food", "🍞"),
    ("medical", "💊"),
    ("shelter", "🏠"),
    ("education", "📚"),
    ("hygiene", "🧼"),
    ("clothing", "👕"),
    ("financial", "💵"),
    ("psychosocial", "🧠"),
    ("other", "📦"),
)
DEFAULT_ICON = "📦"

# Food basket for RATION_BASE_PEOPLE people per month: (item, qty, unit).
RATION_BASE_PEOPLE = 4
RATION_BASKET = (
    ("Rice", 2.0, "kg"),
    ("Bulgur", 1.0, "kg"),
    ("Pasta", 1.0, "kg"),
    ("Lentils", 1.0, "kg"),
    ("Tomato paste", 0.5, "L"),
    ("Sunflower oil", 1.0, "L"),
    ("Canned tuna", 2.0, "cans"),
    ("Sugar", 1.0, "kg"),
    ("Tea", 1.0, "pack"),
    ("Salt", 0.5, "kg"),
)

# Medical supplies: (signal, item, qty per family, unit).
MEDICAL_RULES = (
    ("has_medical", "Paracetamol 500mg", 2, "strips (10 tabs each)"),
    ("has_medical", "Ibuprofen 400mg", 1, "strip (10 tabs)"),
    ("has_medical", "Bandage roll", 2, "pcs"),
    ("has_medical", "Antiseptic solution", 1, "250 ml bottle"),
    ("has_medical", "Disposable gloves", 1, "box (50 pcs)"),
    ("is_pregnant", "Prenatal vitamins", 1, "month pack"),
    ("is_pregnant", "Iron & folic acid tabs", 1, "month pack"),
    ("is_pregnant", "Sterile delivery kit", 1, "kit"),
    ("has_disability", "Wound dressing kit", 1, "set"),
    ("has_disability", "Pressure-relief cushion", 1, "pc"),
    ("has_disability", "Mobility aid voucher", 1, "referral"),
)

# Monthly cost rates in USD: (rate name, amount).
FINANCIAL_RATES = (
    ("Food (per person)", 15),
    ("Basic utilities", 30),
    ("Rent support", 150),
    ("Medical support", 100),
    ("Disability support", 60),
    ("Emergency shelter", 200),
)
# Cost lines of the monthly estimate: (total label, per-family column, rate name, signal or None).
# Food is per person (size x rate); the other lines are per qualifying family.
COST_LINES = (
    ("Food", "food_usd", "Food (per person)", None),
    ("Utilities", "utilities_usd", "Basic utilities", None),
    ("Rent", "rent_usd", "Rent support", "is_renting"),
    ("Medical", "medical_usd", "Medical support", "has_medical"),
    ("Disability", "disability_usd", "Disability support", "has_disability"),
    ("Emergency Shelter", "shelter_usd", "Emergency shelter", "is_homeless"),
)
GRAND_TOTAL = "Grand Total"

# text columns that the analytics column profile keeps
PROFILE_TEXT = ("city", "governorate", "displacement_type", "housing_type", "need_type", "priority_tier")

# Occupation buckets in match order: (bucket, keywords); a keyword matches as a substring.
OCCUPATION_BUCKETS = (
    ("no_work", ("لايوجد", "لا يوجد", "لاتعمل", "لايعمل", "لا يعمل", "لا", "لاعمل",
                 "لا تعمل", "لاشيء", "لا شيء", "بلا وظيفة", "عاطل", "عاجز",
                 "غير عامل", "بلا عمل", "لا عمل", "لابعمل")),
    ("homemaker", ("ربة منزل", "ربه منزل", "ربة اسرة", "ربه اسرة", "ست بيت")),
    ("student", ("طالب", "طالبة", "طالبه", "روضه", "روضة")),
    ("agriculture", ("مزارع", "مزارعة", "زراعة", "زراعه", "بالزراعة", "الزراعة", "فلاح")),
    ("employed", ("موظف", "موظفة", "معلم", "معلمة", "ممرض", "ممرضة", "طبيب", "مهندس")),
    ("self_employed", ("عمل حر", "اعمال حرة", "اعمال حره", "أعمال حرة", "عامل", "عاملة")),
    ("military", ("عسكري", "الجيش", "مجاهد", "أمن", "شرطي")),
    ("retired", ("متقاعد", "متقاعدة", "متقاعده")),
    ("deceased", ("متوفي",)),
    ("child", ("طفل", "طفلة", "طفله", "رضيع")),
)
UNKNOWN_BUCKET = "unknown"
OTHER_BUCKET = "other"
BIRTH_YEAR_PATTERN = r"\b(19\d{2}|20\d{2})\b"

# Signals of the statistics, and fields that a case profile leaves out.
STAT_SIGNALS = (
    ("widows", "is_widow"), ("orphan_families", "is_orphan_family"), ("displaced", "is_displaced"),
    ("with_medical_needs", "has_medical"), ("homeless", "is_homeless"), ("unemployed", "is_unemployed"),
)
PROFILE_SKIP = {"family_id", "family_num", "priority_score", "priority_tier", "source_file", "source_sheet", "city",
                "has_medical", "has_disability"}

# PII column names removed per table role.
PII = {
    "main": (
        "رقم هاتف للعائلة",
        "مدخل البيانات",
        "رقم هاتف مدخل البيانات",
        "العنوان التفصيلي",
        "رقم دفتر العائلة",
        "ملاحظات عن العائلة",
        "ملاحظات عن العائلة لم تذكر سابقا",
        "المركز المجتمعي",
        "عنوان العائلة الأصلي (إذا كانت نازحة من قريبة أخرى)",
        "عنوان العائلة الأصلي",
        "_uuid",
        "_submitted_by",
        "_notes",
        "__version__",
        "_tags",
    ),
    "members": (
        "_parent_table_name",
        "الاسم الاول",
        "الكنية",
        "اسم الاب",
        "اسم الام",
        "الرقم الوطني",
        "رقم هاتف الفرد",
        "تفاصيل الاعتداء",
        "تفاصيل الاعتداء (لو حصل إعتداء)",
        "ملاحظات و تفاصيل خاصة بالفرد",
        "ملاحظات و تفاصيل خاصة بالفرد غير مذكورة سابقا",
        "تاريخ الميلاد",
        "العمل السابق",
        "_submission__uuid",
        "_submission__submitted_by",
        "_submission__notes",
        "_submission___version__",
        "_submission__tags",
    ),
    "damage": (
        "_parent_table_name",
        "معلومات تفصيلية عن الضرر",
        "_submission__uuid",
        "_submission__submitted_by",
        "_submission__notes",
        "_submission___version__",
        "_submission__tags",
    ),
    "needs": (
        "_parent_table_name",
        "تفاصيل الاحتياج",
        "تحديد الاحتياج (غير مذكور سابقا)",
        "تحديد الاحتياج (في حال غير مذكور سابقا)",
        "_submission__uuid",
        "_submission__submitted_by",
        "_submission__notes",
        "_submission___version__",
        "_submission__tags",
    ),
}

# Intake record fields (all read as text, numbers coerced afterwards).
INTAKE_FIELDS = (
    "family_size", "governorate", "city", "displacement_type", "housing_type",
    "dependents", "breadwinners", "need_type", "confidence",
)
INTAKE_NUMERIC = ("family_size", "dependents", "breadwinners")
NEED_ITEM_FIELDS = ("item", "category", "urgency")

# ---------------------------------------------------------------------------
# end of fixed values
# ---------------------------------------------------------------------------

#: Types of the columns that are not text, per table role (what a typed CSV scan converts).
COLUMN_TYPES = {
    "main": {MainCols.ID: "bigint", MainCols.FAMILY_SIZE: "double", MainCols.DEPENDENTS: "double", MainCols.BREADWINNERS: "double",
             MainCols.SURVEY_DATE: "date"},
    "members": {MemberCols.FAMILY_ID: "bigint",
                **{c: "double" for c in (MemberCols.V_IMMEDIATE_HEALTH, MemberCols.V_CHRONIC_DISEASE, MemberCols.V_CHILD_DROPOUT,
                                         MemberCols.V_FEMALE_HOH, *DISABILITY_FLAGS)}},
    "damage": {DamageCols.FAMILY_ID: "bigint", DamageCols.QUANTITY: "double"},
    "needs": {NeedsCols.FAMILY_ID: "bigint", NeedsCols.QUANTITY: "double"},
}

ROLES = ("main", "members", "damage", "needs")


@dataclass(frozen=True)
class CaseTables:
    """The four survey tables of one dataset."""

    main: object
    members: object
    damage: object
    needs: object

    def as_dict(self) -> dict:
        return {"main": self.main, "members": self.members, "damage": self.damage, "needs": self.needs}
