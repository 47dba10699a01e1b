"""Labels, and the ordered substring rules that give them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import any_of, first_match, is_empty, stripped

# ---- Fixed values: class keys in id order, their labels and default subclasses. ----
LABELS = {
    "natural_areas": ("Природные территории", "Парки и скверы"),
    "low_density_degraded": ("Низкоплотная застройка / Деградировавшие антропогенные объекты", "Заброшенные здания"),
    "underused_infrastructure": ("Недоиспользуемые инфраструктурные/городские зоны", "Парковки с низкой загрузкой"),
    "frozen_construction": ("Незавершенное/приостановленное строительство", "Замороженные объекты"),
    "active_construction": ("Активное строительство", "Стройплощадки с активностью"),
    "active_urban": ("Активные городские территории", "Жилая застройка с активностью"),
}
CLASS_KEYS = list(LABELS)
NO_CATEGORY, NO_PANORAMA, PANORAMA, LOW_CONFIDENCE = "Категории нет", "Нет панорамы", "Панорама доступна", "ML: низкая уверенность"
DEFAULT_CLASS, DEFAULT_SUBCLASS = LABELS["active_urban"]
SHORT_DEGRADED = "Низкоплотная застройка / Деградировавшие объекты"
AMBIGUOUS = ["просто зелень", "прочие нежилые"]
HARD_STEMS = ["зелен", "двор"]
EDUCATION, CORRIDORS, PARKING = "Образовательные/медицинские/офисные комплексы", "Интенсивные транспортные коридоры", "Парковки с низкой загрузкой"
PLANNED_PARKS, ROADSIDE, STREETS, HOUSING = "Благоустроенные парки и скверы", "Растительность вдоль дорог", "Коммерческие улицы", "Жилая застройка с активностью"
FORESTS, PARKS, WATER, FIELD, SITES, FROZEN, INDUSTRY, RUINS = "Лесные массивы", "Парки и скверы", "Водные объекты", "Поле", "Стройплощадки с активностью", "Замороженные объекты", "Промзона", "Заброшенные здания"
NATURE, DEGRADED_UI, UNUSED, STALLED, BUILDING, URBAN = LABELS["natural_areas"][0], SHORT_DEGRADED, LABELS["underused_infrastructure"][0], LABELS["frozen_construction"][0], LABELS["active_construction"][0], DEFAULT_CLASS
GREEN = ["зелень", "дерев", "парк", "лес", "газон", "сквер", "насажден"]
SHEDS = ["гараж", "нежил", "прочие нежил", "склад", "ангар", "производств", "промышлен"]
# A rule: the text has one of each list of stems; then class and subclass. The first rule that fits decides.
TEXT_RULES = [
    ([GREEN, ["лес", "лесополос"]], NATURE, FORESTS),
    ([GREEN, ["дорог", "проезж"], ["зелень", "дерев"]], NATURE, ROADSIDE),
    ([GREEN, ["благоустро", "сквер"]], NATURE, PLANNED_PARKS),
    ([GREEN], NATURE, PARKS),
    ([["сельхоз", "распаш", "пашн", "поля ", "поле"]], NATURE, FIELD),
    ([["вод", "река", "пруд", "канал"]], NATURE, WATER),
    ([["стройк", "кран", "стройплощад"]], BUILDING, SITES),
    ([["незаверш", "заморож", "скелет"]], STALLED, FROZEN),
    ([["школ", "детск", "образоват", "вуз", "университет", "научн"]], URBAN, EDUCATION),
    ([["дорог", "транспорт", "развязк", "магистрал", "жд ", "асфальт", "грунт", "открыт"]], URBAN, CORRIDORS),
    ([["мкд", "многоэтаж", "много квартир", "жилой фонд", "ижс", "индивидуальн", "коттедж", "частный сектор", "малоэтаж"]], URBAN, HOUSING),
    ([["администр", "муниципал", "государствен", "ведомств"]], URBAN, EDUCATION),
    ([["коммерц", "бц", "бизнес-ц", "торгов", "тц", "трц", "офисн", "ритейл"]], URBAN, STREETS),
    ([SHEDS, ["промышлен", "завод", "фабрик"]], UNUSED, INDUSTRY),
    ([SHEDS], UNUSED, PARKING),
    ([["заброшен", "разруш", "вандал", "деград"]], DEGRADED_UI, RUINS),
    ([["жил", "застрой", "дом", "квартал", "микрорайон", "здани", "сооруж", "объект", "прочие", "иной", "разное", "территор", "участ", "земел", "надел"]], URBAN, HOUSING),
]
# By class key: stems of each list, then the finer subclass.
SUBCLASS_RULES = {
    "natural_areas": [
        ([["вод", "река", "пруд", "канал", "водоём", "водоем"]], WATER), ([["лес", "лесополос", "лесной"]], FORESTS), ([["поле", "распаш", "пашн", "сельхоз"]], FIELD),
        ([["дорог", "проезж", "тротуар"], ["зелень", "дерев", "раститель", "газон"]], ROADSIDE), ([["благоустро", "сквер", "парк"]], PLANNED_PARKS),
    ],
    "underused_infrastructure": [([["промышлен", "промзон", "завод", "фабрик", "склад", "ангар"]], INDUSTRY), ([["ларьк", "киоск", "будк", "трансформатор", "остановк", "вентиляц"]], "Отдельные сооружения")],
    "active_urban": [
        ([["школ", "детск", "сад", "образоват", "вуз", "университет", "научн"]], EDUCATION), ([["администр", "больниц", "поликлин", "медицин"]], EDUCATION), ([["коммерц", "магазин", "торгов", "тц", "трц", "ритейл"]], STREETS),
        ([["дорог", "транспорт", "развязк", "магистрал", "асфальт", "грунт"]], CORRIDORS), ([["бц", "бизнес", "офис"]], EDUCATION),
    ],
    "active_construction": [([["новая застройк", "новострой"]], "Новая застройка")],
}
ANALYST_KEYS = {
    "природные территории": "natural_areas", "природные (парковые) территории": "natural_areas",
    "низкоплотная застройка / деградировавшие антропогенные объекты": "low_density_degraded", "низкоплотная застройка / деградировавшие объекты": "low_density_degraded",
    "недоиспользуемые инфраструктурные/городские зоны": "underused_infrastructure", "незавершенное/приостановленное строительство": "frozen_construction",
    "активное строительство": "active_construction", "активное строительство (стройплощадки)": "active_construction",
    "активные городские территории": "active_urban", "активные городские территории (фон/контрольный класс)": "active_urban",
}
# Element type, then conditions on tags: (key, None) it is there, (key, value) it is that, (key, [values]) its text has one of those.
TAG_RULES = {
    "natural_areas": [("way", [("landuse", "forest")]), ("way", [("landuse", "meadow")]), ("way", [("landuse", "grass")]), ("way", [("leisure", "park")]), ("way", [("leisure", "nature_reserve")]), ("way", [("natural", "wood")]), ("way", [("natural", "scrub")]), ("relation", [("landuse", "forest")]), ("relation", [("leisure", "park")])],
    "low_density_degraded": [("way", [("building", "abandoned")]), ("way", [("abandoned:building", None)]), ("way", [("disused:building", None)]), ("way", [("abandoned", "yes"), ("building", None)]), ("way", [("disused", "yes"), ("building", None)]), ("way", [("landuse", "residential")]), ("way", [("amenity", "parking"), ("parking", "garage_boxes")]), ("relation", [("building", "abandoned")]), ("relation", [("abandoned", "yes")])],
    "underused_infrastructure": [("way", [("shop", "vacant")]), ("way", [("amenity", "vacant")]), ("way", [("office", "vacant")]), ("way", [("amenity", "parking"), ("parking", ["surface", "multi-storey"])]), ("way", [("building", "commercial")]), ("way", [("building", "retail")]), ("way", [("highway", "bus_stop"), ("disused:highway", "bus_stop")]), ("relation", [("shop", "vacant")])],
    "frozen_construction": [("way", [("landuse", "construction")]), ("way", [("construction", "yes")]), ("way", [("building", "construction")]), ("relation", [("landuse", "construction")])],
    "active_construction": [("way", [("landuse", "construction")]), ("way", [("construction", "yes")]), ("relation", [("landuse", "construction")])],
    "active_urban": [("way", [("building", "apartments")]), ("way", [("building", "residential")]), ("way", [("shop", None)]), ("way", [("amenity", ["cafe", "restaurant"])]), ("way", [("highway", ["primary", "secondary"])]), ("relation", [("building", "apartments")])],
}
# ---- End of fixed values. ----


def _all_of(text: Column, stems: list[list[str]]) -> Column:
    out = any_of(text, stems[0])
    for more in stems[1:]:
        out = out & any_of(text, more)
    return out


def text_class(text: Column, default: tuple[str, str] = ("", "")) -> Column:
    """struct(class_ui, subclass_ui) of a description, the default where no rule fits. The number of the rule is worked out
    by one flat CASE; the pair is looked up in a literal."""
    low = F.lower(stripped(F.when(is_empty(text), F.lit("")).otherwise(text)))
    number = first_match([(_all_of(low, stems), F.lit(i)) for i, (stems, *_) in enumerate(TEXT_RULES, 1)], F.lit(len(TEXT_RULES) + 1))
    pairs = F.array(*[F.struct(F.lit(a).alias("class_ui"), F.lit(b).alias("subclass_ui")) for a, b in [*(r[1:] for r in TEXT_RULES), default]])
    return F.element_at(pairs, number)


def text_class_or_default(text: Column) -> Column:
    return text_class(text, (DEFAULT_CLASS, DEFAULT_SUBCLASS))


def refined_subclass(key: Column, text: Column, default: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return first_match([((key == k) & _all_of(low, stems), F.lit(sub)) for k, rules in SUBCLASS_RULES.items() for stems, sub in rules], default)


def analyst_key(label: Column) -> Column:
    """Class key of an analyst's label: exact, else by the first known label that holds it or is held by it; null for empty ones."""
    low = F.lower(F.trim(label))
    exact = F.element_at(F.create_map(*[F.lit(x) for pair in ANALYST_KEYS.items() for x in pair]), low)
    near = [(low.contains(known) | F.lit(known).contains(low), F.lit(key)) for known, key in ANALYST_KEYS.items()]
    return F.when(low.isNotNull() & ~low.isin("", "nan", NO_CATEGORY.lower()), F.coalesce(exact, first_match(near, F.lit(None).cast("string"))))


def is_valid_label(label: Column) -> Column:
    return label.isNotNull() & ~F.trim(label).isin("", "nan", NO_CATEGORY)


def is_ambiguous(text: Column) -> Column:
    return any_of(F.lower(F.trim(F.coalesce(text, F.lit("")))), AMBIGUOUS)


def is_hard_case(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return low.contains(HARD_STEMS[0]) & low.contains(HARD_STEMS[1])


def label_of(key: Column, part: int = 0) -> Column:
    """Label (0) or default subclass (1) of a class key."""
    known = F.create_map(*[F.lit(x) for k, v in LABELS.items() for x in (k, v[part])])
    return F.coalesce(F.element_at(known, F.coalesce(key, F.lit(""))), F.lit(LABELS["active_urban"][part]))


def tag_classes(kind: Column, tags: Column) -> Column:
    """All classes whose predicates an element meets."""

    def holds(key: str, want) -> Column:
        got = F.element_at(tags, F.lit(key))
        return F.coalesce(got.isNotNull() if want is None else any_of(got, want) if isinstance(want, list) else got == want, F.lit(False))

    def meets(element: str, wants: list) -> Column:
        out = kind == element
        for key, want in wants:
            out = out & holds(key, want)
        return out

    def any_rule(rules: list) -> Column:
        out = meets(*rules[0])
        for r in rules[1:]:
            out = out | meets(*r)
        return out

    return F.array_compact(F.array(*[F.when(any_rule(rules), F.lit(name)) for name, rules in TAG_RULES.items()]))


def parsed_class(text: Column) -> Column:
    """The longest class key that the lower-cased answer contains, else null."""
    low = F.lower(text)
    return first_match([(low.contains(k), F.lit(k)) for k in sorted(CLASS_KEYS, key=lambda k: (-len(k), k))], F.lit(None).cast("string"))


def is_confident(text: Column) -> Column:
    return ~F.lower(F.coalesce(text, F.lit(""))).contains("unsure")


MACRO = {"natural_areas": "natural_areas", "frozen_construction": "construction", "active_construction": "construction", "low_density_degraded": "built_up", "underused_infrastructure": "built_up", "active_urban": "built_up"}


def regrouped(key: Column, groups: int) -> Column:
    """Six classes as five (both constructions in one) or three."""
    if groups == 6:
        return key
    if groups == 5:
        return F.when(key.isin("frozen_construction", "active_construction"), "construction").otherwise(key)
    return first_match([(key == k, F.lit(v)) for k, v in MACRO.items()], F.lit("natural_areas"))
