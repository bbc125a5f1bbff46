"""Numbers, units and dimension records, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of units and what one of them is in millimetres or grams.
LENGTHS: dict[float, str] = {
    1.0: "mm millimeter millimeters milimetr milimetry",
    10.0: "cm centimeter centimeters centymetr centymetry",
    1000.0: "m meter meters metr metry",
    25.4: 'in inch inches " cal cale',
    304.8: "ft foot feet ' stopa stopy",
    914.4: "yd yard yards",
    0.001: "um µm micrometer",
}
WEIGHTS: dict[float, str] = {
    1.0: "g gram grams gm gramy gramow",
    1000.0: "kg kilogram kilograms kilo kilogramy",
    0.001: "mg milligram milligrams miligram miligramy",
    453.59237: "lb lbs pound pounds funt funty",
    28.349523: "oz ounce ounces uncja uncje",
    1_000_000.0: "t tonne tonnes tona tony",
}
MASS_UNITS = {"G": 1.0, "KG": 1000.0, "MG": 0.001, "T": 1e6}
NUMBER = r"(\d+(?:\.\d+)?)"
TIMES = r"\s*[xX*×]\s*"
TRIPLE = NUMBER + TIMES + NUMBER + TIMES + NUMBER
LABELS = {
    "length": r"(?:length|długość|dlugosc)",
    "width": r"(?:width|szerokość|szerokosc)",
    "height": r"(?:height|wysokość|wysokosc)",
    "diameter": r"(?:diameter|średnica|srednica|Ø|OD|ID)",
    "weight": r"(?:weight|waga|masa|mass)",
}
LENGTH_VALUE = r"[^\d\n]*?(\d+(?:\.\d+)?\s*(?:mm|cm|m|in|inches?|\"|ft))\b"
DIAMETER_VALUE = r"[^\d\n]*?(\d+(?:\.\d+)?\s*(?:mm|cm|in|\"))\b"
WEIGHT_VALUE = r"[^\d\n]*?(\d+(?:\.\d+)?\s*(?:lbs?|pounds?|oz|ounces?|kg|kilograms?|g|grams?|mg))\b"
POUNDS_OUNCES = r"(\d+(?:\.\d+)?)\s*(?:lbs?|pounds?)\s*(\d+(?:\.\d+)?)\s*(?:oz|ounces?)"


def spellings(table: dict[float, str]) -> list[tuple[str, float]]:
    """Spellings, longest first, in the order in which they are looked for."""
    return sorted(((u, f) for f, us in table.items() for u in us.split()), key=lambda x: -len(x[0]))


def let(value: Column, use) -> Column:
    """use(value) with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def european_number(c: Column) -> Column:
    """A number with a comma or point as decimal sign; anything else is null."""
    return F.replace(F.trim(c), F.lit(","), F.lit(".")).try_cast("double")


def grams(weight: Column, unit: Column) -> Column:
    """A weight in one of the units of mass; null for other units."""
    u = F.upper(F.trim(unit))
    factor = F.lit(None).cast("double")
    for name, f in MASS_UNITS.items():
        factor = F.when(u == name, F.lit(f)).otherwise(factor)
    return weight * factor


def per_piece_cm3(cubic_metres: Column, quantity: Column) -> Column:
    return F.try_divide(cubic_metres, F.nullif(quantity, F.lit(0.0))) * 1e6


def matched(c: Column, pattern: str, group: int = 1) -> Column:
    """What a group of the first match holds; null where nothing matches."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def decimal_point(c: Column) -> Column:
    """A comma beside a point separates thousands, and so does one comma before exactly three
    digits; other commas are decimal signs."""
    one = F.length(c) - F.length(F.replace(c, F.lit(","), F.lit(""))) == 1
    thousands = c.contains(",") & (c.contains(".") | (one & c.rlike(r"\d[^,]*,\d{3}(?:\D|$)")))
    return F.when(thousands, F.replace(c, F.lit(","), F.lit(""))).otherwise(F.replace(c, F.lit(","), F.lit(".")))


def fraction(c: Column) -> Column:
    """a/b or whole a/b once letters and quotes are out; null for others and for a zero below."""
    t = F.trim(F.regexp_replace(c, "[a-zA-Z\"'µ]+", ""))
    part = lambda p, g: F.nullif(F.regexp_extract(t, p, g), F.lit("")).cast("double")
    mixed, plain = r"^(\d+)\s+(\d+)/(\d+)$", r"^(\d+)/(\d+)$"
    return F.coalesce(part(mixed, 1) + F.try_divide(part(mixed, 2), part(mixed, 3)), F.try_divide(part(plain, 1), part(plain, 2)))


def numeric_value(c: Column) -> Column:
    """A fraction, else the middle of a range, else the first number."""
    t = decimal_point(F.trim(c))
    span = NUMBER + r"\s*(?:-|–|to|\.\.)\s*" + NUMBER
    middle = (matched(t, span, 1).cast("double") + matched(t, span, 2).cast("double")) / 2
    return F.coalesce(fraction(t), middle, matched(t, NUMBER).cast("double"))


def unit_factor(c: Column, table: dict[float, str], otherwise: float = 1.0) -> Column:
    """The factor of the longest spelling that stands in a text without letters beside it."""
    out = F.lit(otherwise)
    for u, f in reversed(spellings(table)):
        test = c.contains(u) if u in "\"'" else c.rlike(rf"(?<![a-zA-Z]){u}(?![a-zA-Z])")
        out = F.when(test, F.lit(f)).otherwise(out)
    return out


def length_mm(c: Column) -> Column:
    t = F.lower(F.trim(c))
    n = numeric_value(t)
    return F.when(n > 0, F.round(n * unit_factor(t, LENGTHS), 2))


def weight_g(c: Column) -> Column:
    t = F.lower(F.trim(c))
    both = matched(t, POUNDS_OUNCES, 1).cast("double") * 453.59237 + matched(t, POUNDS_OUNCES, 2).cast("double") * 28.349523
    n = numeric_value(t)
    return F.coalesce(F.round(both, 2), F.when(n > 0, F.round(n * unit_factor(t, WEIGHTS), 2)))


def triple_mm(c: Column) -> Column:
    """Length, width and height in millimetres from a text like 10 x 5 x 2 in."""
    full = TRIPLE + r"\s*([a-zA-Z\"'µ]+)?"
    unit = F.lower(F.coalesce(F.nullif(F.regexp_extract(c, full, 4), F.lit("")), F.lit("mm")))
    factor = F.lit(1.0)
    for u, f in reversed(spellings(LENGTHS)):
        factor = F.when(unit.contains(u), F.lit(f)).otherwise(factor)
    return F.when(c.rlike(full), F.struct(*[F.round(F.regexp_extract(c, full, i).cast("double") * factor, 2).alias(n) for i, n in enumerate(("length", "width", "height"), 1)]))


def metric_record(length: Column, width: Column, height: Column, diameter: Column, weight: Column) -> Column:
    """The record in millimetres, grams and cubic centimetres from raw texts. A length that holds
    all three sizes gives them if width or height is missing; a diameter stands for both if
    both are."""
    raw = F.struct(*[c.alias(n) for n, c in zip("lwhdg", (length, width, height, diameter, weight))])
    sizes = lambda r: F.struct(*[length_mm(r[n]).alias(n) for n in "lwhd"], weight_g(r["g"]).alias("g"), triple_mm(r["l"]).alias("t"))
    return let(let(let(raw, sizes), _filled), _record)


def _filled(m: Column) -> Column:
    some = m["t"].isNotNull() & (m["w"].isNull() | m["h"].isNull())
    l, w, h = (F.when(some, m["t"][n]).otherwise(m[k]) for k, n in (("l", "length"), ("w", "width"), ("h", "height")))
    round_ = m["d"].isNotNull() & w.isNull() & h.isNull()
    return F.struct(l.alias("l"), F.when(round_, m["d"]).otherwise(w).alias("w"), F.when(round_, m["d"]).otherwise(h).alias("h"), m["d"].alias("d"), m["g"].alias("g"))


def _record(m: Column) -> Column:
    l, w, h, d, g = (m[k] for k in "lwhdg")
    flat = F.concat(F.concat_ws(" x ", l.cast("string"), w.cast("string"), h.cast("string")), F.lit(" mm"))
    tube = F.concat(F.lit("Ø "), d.cast("string"), F.lit(" x "), l.cast("string"), F.lit(" mm"))
    shown = F.when(l.isNotNull() & w.isNotNull() & h.isNotNull(), flat).when(d.isNotNull() & l.isNotNull(), tube)
    fields = {"length_mm": l, "width_mm": w, "height_mm": h, "diameter_mm": d, "weight_g": g, "weight_kg": F.round(g / 1000, 4), "volume_cm3": F.round(l * w * h / 1000, 2), "dimension_string_mm": shown}
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def raw_dimensions(text: Column) -> Column:
    """Raw sizes and weight that patterns find in a text, with a confidence."""
    triple = TRIPLE + r"\s*([a-zA-Z\"'µ]+)"
    has_triple = text.rlike(triple)

    def sized(i: int, label: str) -> Column:
        own = matched(text, "(?i)" + LABELS[label] + LENGTH_VALUE)
        return F.when(has_triple, F.concat(F.regexp_extract(text, triple, i), F.lit(" "), F.regexp_extract(text, triple, 4))).otherwise(own)

    length, width, height = sized(1, "length"), sized(2, "width"), sized(3, "height")
    diameter = matched(text, "(?i)" + LABELS["diameter"] + DIAMETER_VALUE)
    weight = F.coalesce(matched(text, r"(?i)(\d+(?:\.\d+)?\s*lbs?\s*\d+(?:\.\d+)?\s*oz)"), matched(text, "(?i)" + LABELS["weight"] + WEIGHT_VALUE))
    confidence = F.when(has_triple, 0.9).when(length.isNotNull() | weight.isNotNull(), 0.85).otherwise(0.0)
    found = F.coalesce(length, width, height, diameter, weight).isNotNull()
    fields = {"found": found, "raw_length": length, "raw_width": width, "raw_height": height, "raw_diameter": diameter, "raw_weight": weight, "confidence": confidence, "source_snippet": matched(text, f"({triple})")}
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def log_size(c: Column, least: float = 1e-4) -> Column:
    """log10 of a size clipped from below; null and non-finite values are null."""
    return F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")), F.log10(F.greatest(c, F.lit(least))))


def clamp01(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 where either vector is null or zero."""
    n = norm(a) * norm(b)
    return F.coalesce(F.when(n > 0, dot(a, b) / n), F.lit(0.0))
