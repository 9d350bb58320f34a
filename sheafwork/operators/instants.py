"""Mixed timestamp notations to one instant in UTC.

Every notation is one branch of a single regex with named groups. One regexp_replace writes all groups of
the matching branch into a delimited string (a group that took no part writes nothing), so the text is
scanned once and all components come out of that scan. Validation and the instant itself are integer
arithmetic on days since 1970-01-01. Everything runs in generated JVM code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sheafwork.functions.text import ascii_fold

# Month names in English, French and German without accents, by number.
MONTHS = {
    1: ("jan", "january", "janvier", "janv", "januar", "janner"), 2: ("feb", "february", "fevrier", "fevr", "fev", "februar"),
    3: ("mar", "march", "mars", "marz", "maerz", "mrz"), 4: ("apr", "april", "avril", "avr"), 5: ("may", "mai"), 6: ("jun", "june", "juin", "juni"),
    7: ("jul", "july", "juillet", "juil", "juli"), 8: ("aug", "august", "aout"), 9: ("sep", "sept", "september", "septembre"),
    10: ("oct", "october", "octobre", "okt", "oktober"), 11: ("nov", "november", "novembre"), 12: ("dec", "december", "decembre", "dez", "dezember"),
}
_NAMES = sorted((n for names in MONTHS.values() for n in names), key=lambda n: (-len(n), n))
_MONTH = "|".join(_NAMES)

_CLOCK = (
    r"(?:(?:T|,?\s+(?:(?:a|at|um)\s+)?)(?:(?<h>\d{1,2})(?:[:h.](?<mi>\d{2})(?:[:.](?<s>\d{2})(?:[.,](?<f>\d{1,9}))?)?|h)"
    r"|(?<hc>\d{2})(?<mic>\d{2})(?:(?<sc>\d{2})(?:[.,](?<fc>\d{1,9}))?)?)"
    r"(?:\s*(?<ap>[ap])\.?\s?m\b\.?)?(?:\s*(?:uhr|hrs?)\b\.?)?)?"
)
_ZONE = r"(?:\s*[\[(]?\s*(?:(?<rg>[A-Z]+(?:/[A-Z0-9_+-]+){1,2})|(?:(?<zl>[A-Z][A-Z ]*?)\s?)?(?<zo>[+-]\d{1,2}(?::?\d{2})?)?)\s*[\])]?)"
_DATES = "|".join(
    [
        r"(?<ya>\d{4})(?<sa>[-/.])(?<ma>\d{1,2})\k<sa>(?<da>\d{1,2})",
        r"(?<yb>\d{4})(?<mb>\d{2})(?<db>\d{2})(?=T|$)",
        r"(?<na>\d{1,2})(?<sn>[-/.])(?<nb>\d{1,2})\k<sn>(?<yn>\d{4}|\d{2})",
        rf"(?<dd>\d{{1,2}})(?:er|st|nd|rd|th)?\.?[\s-]*(?<md>{_MONTH})\b\.?[\s,-]*(?<yd>\d{{4}}|\d{{2}})",
        rf"(?<me>{_MONTH})\b\.?\s+(?<de>\d{{1,2}})(?:st|nd|rd|th)?,?\s+(?<ye>\d{{4}})",
    ]
)
_PATTERN = (
    r"(?i)^(?:[^0-9]*[^0-9A-Z])?(?:"
    rf"(?:{_DATES})(?![0-9]){_CLOCK}{_ZONE}"
    r"|(?<ep>\d{9,19})(?:\.(?<epf>\d{1,9}))?|(?<xl>\d{5}(?:[.,]\d{1,12})?)"
    r")\s*\.?$"
)
_FIELDS = {
    "y": "ya yb", "mo": "ma mb", "d": "da db dd de", "na": "na", "nb": "nb", "y2": "yn yd ye", "mn": "md me", "h": "h hc", "mi": "mi mic", "s": "s sc",
    "f": "f fc", "ap": "ap", "rg": "rg", "zl": "zl", "zo": "zo", "ep": "ep", "epf": "epf", "xl": "xl",
}
_MARK = "\u0001"
_REPLACEMENT = _MARK + _MARK.join("".join("${%s}" % g for g in groups.split()) for groups in _FIELDS.values())


def zone_ids(spark: SparkSession) -> DataFrame:
    """The IANA ids this JVM knows: a fixed list of about 600 rows."""
    ids = sorted(str(z) for z in spark._jvm.java.time.ZoneId.getAvailableZoneIds() if "/" in str(z))
    return spark.createDataFrame([(z.lower(), z) for z in ids], "zone_key string, zone_id string")


def _days(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a proleptic Gregorian date, in integers (March-based years)."""
    yy = y - F.when(m <= 2, 1).otherwise(0)
    era = F.floor(yy / 400)
    yoe = yy - era * 400
    doy = F.floor((153 * (m + F.when(m > 2, -3).otherwise(9)) + 2) / 5) + d - 1
    return (era * 146097 + yoe * 365 + F.floor(yoe / 4) - F.floor(yoe / 100) + doy - 719468).cast("long")


def _real(y: Column, m: Column, d: Column) -> Column:
    """Whether the date exists; false, never null, for missing parts."""
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    last = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    return F.coalesce((y >= 1000) & m.between(1, 12) & (d >= 1) & (d <= last), F.lit(False))


def extract_components(df: DataFrame, text: str) -> DataFrame:
    """Add one column `_p`, an array of the named components, or null where no notation matches."""
    raw = F.regexp_replace(ascii_fold(F.col(text)), _PATTERN, _REPLACEMENT)
    return df.withColumn("_p", F.when(raw.startswith(_MARK), F.split(raw, _MARK)))


def to_utc(df: DataFrame, zones: DataFrame, labels: DataFrame, text: str = "text", zone: str = "issuer_zone", day_first: str = "day_first") -> DataFrame:
    """Add `utc_us` (microseconds since 1970-01-01 UTC, or null) to every row.

    A zone in the text (offset, label or region) comes before `zone`; a text that needs one and has neither
    is null. A numeric date with two readings follows `day_first` and is null without it. A wall time that
    occurs twice is its first occurrence; one that is skipped takes the offset before the change. Null,
    blank, impossible or foreign texts give null. Repeated rows are kept; other columns pass through, whatever
    their names; a column `utc_us` of the input is replaced.
    """
    pick = {name: F.nullif(F.element_at("_p", i + 2), F.lit("")) for i, name in enumerate(_FIELDS)}
    num = {k: pick[k].cast("int") for k in ("y", "mo", "d", "na", "nb", "h", "mi", "s")}
    month = F.lower(pick["mn"])
    named = F.coalesce(*[F.when(month.isin(*names), F.lit(n)) for n, names in MONTHS.items()])
    year = F.coalesce(num["y"], pick["y2"].cast("int") + F.when(F.length(pick["y2"]) == 2, 2000).otherwise(0))
    keep = [c for c in df.columns if c != "utc_us"]
    packed = df.select(F.struct(*keep).alias("__row"), F.col(text).alias("__text"), F.col(zone).alias("__zone"), F.col(day_first).cast("boolean").alias("__first"))
    fold = extract_components(packed, "__text")
    parts = fold.select(
        "*", year.alias("_y"), F.coalesce(num["mo"], named).alias("_m"), num["d"].alias("_d"), num["na"].alias("_a"), num["nb"].alias("_b"),
        num["h"].alias("_h"), F.coalesce(num["mi"], F.lit(0)).alias("_mi"), F.coalesce(num["s"], F.lit(0)).alias("_s"),
        _micros(pick["f"]).alias("_f"), F.lower(pick["ap"]).alias("_ap"),
        F.lower(pick["rg"]).alias("_rg"), F.lower(pick["zl"]).alias("_zl"), pick["zo"].alias("_zo"),
        pick["ep"].alias("_ep"), _micros(pick["epf"]).alias("_ef"),
        F.translate(pick["xl"], ",", ".").cast("decimal(22,12)").alias("_xl"),
    )
    day, month_ = F.col("_d"), F.col("_m")
    a, b, y = F.col("_a"), F.col("_b"), F.col("_y")
    dm, md = _real(y, b, a), _real(y, a, b)
    first = F.when(dm & md & (a != b), F.col("__first")).when(dm, F.lit(True)).when(md, F.lit(False))
    dated = parts.withColumns({"_d": F.when(a.isNull(), day).when(first, a).when(~first, b), "_m": F.when(a.isNull(), month_).when(first, b).when(~first, a)})
    hour = F.col("_h")
    half = F.when(hour.between(1, 12), hour % 12 + F.when(F.col("_ap") == "p", 12).otherwise(0))
    dated = dated.withColumn("_h", F.when(F.col("_ap").isNotNull(), half).otherwise(F.coalesce(hour, F.lit(0))))
    good = _real(y, F.col("_m"), F.col("_d")) & F.coalesce(F.col("_h").between(0, 23) & (F.col("_mi") <= 59) & (F.col("_s") <= 59), F.lit(False))
    seconds = (_days(y, F.col("_m"), F.col("_d")) * 86400 + F.col("_h") * 3600 + F.col("_mi") * 60 + F.col("_s")).cast("long")
    sheet = F.floor((F.col("_xl") - 25569) * F.lit(86400000000).cast("decimal(12,0)")).cast("long")
    wall = F.when(F.col("_xl").isNotNull(), sheet).when(good, seconds * 1000000 + F.col("_f"))
    digits = F.length("_ep")
    count = F.col("_ep").cast("decimal(20,0)")
    epoch = (
        F.when(digits <= 11, (count * 1000000).cast("long") + F.col("_ef"))
        .when(digits <= 14, (count * 1000).cast("long"))
        .when(digits <= 17, count.cast("long"))
        .otherwise(F.floor(count / 1000).cast("long"))
    )
    hh = F.regexp_extract("_zo", r"^[+-](\d{1,2})", 1).cast("int")
    mm = F.coalesce(F.nullif(F.regexp_extract("_zo", r"^[+-]\d{1,2}:?(\d{2})$", 1), F.lit("")).cast("int"), F.lit(0))
    shift = F.when(F.col("_zo").isNotNull(), (hh * 60 + mm) * F.when(F.col("_zo").startswith("-"), -1).otherwise(1))
    dated = dated.withColumns({"_wall": wall, "_epoch": epoch, "_shift": shift})

    label = labels.select(F.lower("label").alias("_zl"), F.col("offset_min").alias("_lo"))
    region = zones.select(F.col("zone_key").alias("_rg"), F.col("zone_id").alias("_rid"))
    issuer = zones.select(F.col("zone_key").alias("_ik"), F.col("zone_id").alias("_iid"))
    joined = (
        dated.withColumn("_ik", F.lower(F.trim("__zone")))
        .join(label, "_zl", "left").join(region, "_rg", "left").join(issuer, "_ik", "left")
    )
    base = F.when(F.col("_zl").isNull(), F.lit(0)).when(F.col("_zl") == "z", F.lit(0)).otherwise(F.col("_lo"))
    given = F.col("_zl").isNotNull() | F.col("_zo").isNotNull()
    offset = base + F.coalesce("_shift", F.lit(0))
    rules = F.when(F.col("_rg").isNotNull(), F.col("_rid")).otherwise(F.col("_iid"))
    local = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros("_wall"), rules))
    instant = F.when(F.col("_ep").isNotNull(), F.col("_epoch")).when(given & F.col("_rg").isNull(), F.col("_wall") - offset.cast("long") * 60000000).otherwise(local)
    return joined.select("__row.*", instant.alias("utc_us"))


def _micros(fraction: Column) -> Column:
    """The first six digits of a decimal fraction as microseconds."""
    return F.rpad(F.coalesce(fraction, F.lit("0")), 6, "0").substr(1, 6).cast("long")
