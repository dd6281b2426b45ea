"""Mixed timestamp formats and zones to one instant: microseconds since the epoch in UTC.

All known formats are alternatives of one regular expression with named groups. A value is
matched once; the components come out of that one match, are checked against the calendar and
assembled by integer day arithmetic. Everything stays in JVM expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# English month names, and the usual zone abbreviations in minutes east of UTC.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
ABBREVIATIONS = {
    "z": 0, "utc": 0, "gmt": 0, "ut": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120,
    "eet": 120, "eest": 180, "msk": 180, "ist": 330, "jst": 540, "kst": 540, "aest": 600, "aedt": 660,
    "acst": 570, "acdt": 630, "awst": 480, "nzst": 720, "nzdt": 780, "est": -300, "edt": -240,
    "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420,
}

_MONTH = "(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\\.?"
_DAY_NAME = "(?:(?:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?,? )?"


def _clock(k: int) -> str:
    """Hour and minute, and perhaps second, fraction, half of the day and zone."""
    zone = "|".join(sorted(ABBREVIATIONS, key=len, reverse=True))
    return (
        f"(?<h{k}>[0-9]{{1,2}}):(?<mi{k}>[0-9]{{2}})(?::(?<s{k}>[0-9]{{2}})(?:[.,](?<f{k}>[0-9]+))?)?"
        f"(?: ?(?<ap{k}>[ap])\\.?m\\.?)?"
        f"(?: ?(?:(?<zs{k}>[+-])(?<zh{k}>[0-9]{{1,2}})(?::?(?<zm{k}>[0-9]{{2}}))?|(?:(?<=[0-9. ]|m)(?<za{k}>{zone}))))?"
        f"(?: ?\\[?(?<zn{k}>[a-z]+(?:/[a-z_+-]+[0-9]*)+|(?<=\\[)[a-z]+)\\]?)?"
    )


#: Each format is a date followed by a clock; {k} numbers the groups, which must differ in name.
_DATES = [
    # 2020-03-04T05:06:07.8Z, 2020-03-04 05:06 +01:00, 2020/03/04 05:06
    "(?<y{k}>[0-9]{{4}})(?:-(?<m{k}>[0-9]{{1,2}})-|/(?<ma{k}>[0-9]{{1,2}})/)(?<d{k}>[0-9]{{1,2}})(?:[t_]| t?)",
    # 03/04/2020 05:06, 03.04.2020 05:06, 3-4-2020, 05:06: the feed says which is the day
    "(?<p{k}>[0-9]{{1,2}})([/.-])(?<q{k}>[0-9]{{1,2}})\\{back}(?<y{k}>[0-9]{{4}})(?:t|,? )",
    # Sat, 04 Mar 2020 05:06:07 +0100, 4-Mar-2020 05:06
    _DAY_NAME + "(?<d{k}>[0-9]{{1,2}})(?:st|nd|rd|th)?\\.?[ -](?<n{k}>" + _MONTH + "),?[ -](?<y{k}>[0-9]{{4}})(?:t|,? (?:at )?)",
    # Mar 4, 2020 05:06:07 UTC
    _DAY_NAME + "(?<n{k}>" + _MONTH + ") (?<d{k}>[0-9]{{1,2}})(?:st|nd|rd|th)?,? (?<y{k}>[0-9]{{4}})(?:t|,? (?:at )?)",
]
_OTHER = [
    # Wed Mar  4 05:06:07 UTC 2020, as ctime() and date(1) write it
    _DAY_NAME + "(?<n{k}>" + _MONTH + ") (?<d{k}>[0-9]{{1,2}}) (?<h{k}>[0-9]{{2}}):(?<mi{k}>[0-9]{{2}}):(?<s{k}>[0-9]{{2}})"
    "(?: (?<za{k}>" + "|".join(sorted(ABBREVIATIONS, key=len, reverse=True)) + "))? (?<y{k}>[0-9]{{4}})",
    # 20200304T050607Z, 20200304T0506+0100
    "(?<y{k}>[0-9]{{4}})(?<m{k}>[0-9]{{2}})(?<d{k}>[0-9]{{2}})(?:t| )(?<h{k}>[0-9]{{2}})(?<mi{k}>[0-9]{{2}})"
    "(?:(?<s{k}>[0-9]{{2}})(?:[.,](?<f{k}>[0-9]+))?)?(?: ?(?:(?<zs{k}>[+-])(?<zh{k}>[0-9]{{2}})(?::?(?<zm{k}>[0-9]{{2}}))?|(?<za{k}>z|utc|gmt)))?",
    # seconds, milliseconds, microseconds or nanoseconds since the epoch, by their number of digits
    "(?<es{k}>-?[0-9]{{9,10}})(?:\\.(?<ef{k}>[0-9]+))?|(?<em{k}>-?[0-9]{{12,13}})|(?<eu{k}>-?[0-9]{{15,16}})|(?<en{k}>-?[0-9]{{18,19}})",
]

_PARTS = ["y", "m", "n", "d", "p", "q", "h", "mi", "s", "f", "ap", "zs", "zh", "zm", "za", "zn", "es", "ef", "em", "eu", "en"]


def _compile() -> tuple[str, str]:
    """The alternation, and the replacement that lays its groups out in the order of _PARTS."""
    formats, names = [], {part: [] for part in _PARTS}
    for k, date in enumerate(_DATES):
        formats.append(date.format(k=k, back="k<sep>") + _clock(k))
    formats += [other.format(k=len(_DATES) + j) for j, other in enumerate(_OTHER)]
    # The separator of an all-numeric date must be the same twice.
    formats[1] = formats[1].replace("([/.-])", "(?<sep>[/.-])")
    pattern = "^(?:" + "|".join(formats) + ")$"
    for part in _PARTS:
        for k in range(len(formats)):
            for name in (f"{part}{k}", f"{part}a{k}" if part == "m" else ""):
                if name and f"(?<{name}>" in pattern:
                    names[part].append("${" + name + "}")
    return pattern, "\u0001" + "|".join("".join(names[part]) for part in _PARTS)


PATTERN, _LAYOUT = _compile()


def days_from_civil(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a proleptic Gregorian date, by integers alone."""
    yy = y - F.when(m <= 2, 1).otherwise(0)
    era = F.floor(yy / 400)
    yoe = yy - era * 400
    doy = F.floor((153 * (m + F.when(m > 2, -3).otherwise(9)) + 2) / 5) + d - 1
    doe = yoe * 365 + F.floor(yoe / 4) - F.floor(yoe / 100) + doy
    return (era * 146097 + doe - 719468).cast("long")


def with_utc_micros(df: DataFrame, value: str, zone: str, day_first: str, out: str = "utc_us") -> DataFrame:
    """Add `out`: the instant that the string column `value` denotes, or null.

    `zone` names a column with the IANA zone of the writer's wall clock, `day_first` a boolean
    column for all-numeric dates. An offset, abbreviation or zone in the value goes before
    `zone`. A wall-clock time that occurs twice is its first occurrence, one that never occurs
    is null, as are dates without time, impossible dates and times (24:00 and second 60
    included), unknown zones, null and any other text. Without any zone, null.
    Missing seconds are 0, digits beyond microseconds are cut off. A column of the name `out`
    is replaced; other columns pass through.
    """
    text = F.trim(F.regexp_replace(F.lower(F.col(value)), r"[\s\u00a0\u202f]+", " "))
    laid = F.regexp_replace(text, PATTERN, _LAYOUT)
    split = F.when(laid.startswith("\u0001"), F.split(F.substring(laid, 2, 1 << 20), r"\|"))
    df = _computed(df, __ts_split=split)
    df = _computed(df, **{f"__ts_{p}": F.nullif(F.get(F.col("__ts_split"), F.lit(i)), F.lit("")) for i, p in enumerate(_PARTS)})
    part = {p: F.col(f"__ts_{p}") for p in _PARTS}

    def number(p: str) -> Column:
        return part[p].try_cast("long")

    month_of_name = F.lit(None).cast("long")
    for i, m in reversed(list(enumerate(MONTHS))):
        month_of_name = F.when(F.substring(part["n"], 1, 3) == m, F.lit(i + 1).cast("long")).otherwise(month_of_name)
    first_is_day = F.coalesce(F.col(day_first), F.lit(False))
    month = F.coalesce(number("m"), month_of_name, F.when(first_is_day, number("q")).otherwise(number("p")))
    day = F.coalesce(number("d"), F.when(first_is_day, number("p")).otherwise(number("q")))
    year, hour, half = number("y"), number("h"), part["ap"]
    hour24 = F.when(half.isNull(), hour).when(
        hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0)
    )
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    longest = F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
    second = F.coalesce(number("s"), F.lit(0))
    valid = (
        year.between(1, 9999) & month.between(1, 12) & (day >= 1) & (day <= longest)
        & hour24.between(0, 23) & number("mi").between(0, 59) & second.between(0, 59)
    )

    def micros(p: str) -> Column:
        return F.coalesce(F.rpad(F.substring(part[p], 1, 6), 6, "0").try_cast("long"), F.lit(0))

    wall = ((days_from_civil(year, month, day) * 24 + hour24) * 60 + number("mi")) * 60 + second
    zh, zm = number("zh"), F.coalesce(number("zm"), F.lit(0))
    abbreviation = F.element_at(
        F.create_map(*[F.lit(x) for pair in ABBREVIATIONS.items() for x in pair]), part["za"]
    )
    offset = F.when(
        part["zh"].isNotNull(), F.when((zh <= 18) & (zm <= 59), (zh * 60 + zm) * F.when(part["zs"] == "-", -1).otherwise(1))
    ).otherwise(abbreviation)
    has_offset = part["zh"].isNotNull() | part["za"].isNotNull()
    # Zone names are matched in lower case; Java's own list gives their spelling back.
    named = F.when(part["zn"].isNotNull(), F.element_at(_zone_names(df.sparkSession), part["zn"])).otherwise(
        F.element_at(_zone_names(df.sparkSession), F.lower(F.col(zone)))
    )
    sign = F.when(part["es"].startswith("-"), -1).otherwise(1)
    epoch = F.coalesce(
        number("es") * 1_000_000 + sign * micros("ef"), number("em") * 1000, number("eu"), F.floor(number("en") / 1000)
    )
    df = _computed(
        df,
        __ts_wall=F.when(valid, wall * 1_000_000 + micros("f")), __ts_epoch=epoch.cast("long"),
        __ts_offset=offset.cast("long"), __ts_has=has_offset, __ts_zone=named,
    )
    local = F.timestamp_micros("__ts_wall")
    utc = F.to_utc_timestamp(local, F.col("__ts_zone"))
    exists = F.from_utc_timestamp(utc, F.col("__ts_zone")) == local
    instant = (
        F.when(F.col("__ts_wall").isNull(), F.col("__ts_epoch"))
        .when(F.col("__ts_has"), F.col("__ts_wall") - F.col("__ts_offset") * 60_000_000)
        .when(F.col("__ts_zone").isNotNull() & exists, F.unix_micros(utc))
    )
    df = _computed(df, __out=instant.cast("long"))
    return df.drop(out, *[c for c in df.columns if c.startswith("__ts_")]).withColumnRenamed("__out", out)


def _computed(df: DataFrame, **columns: Column) -> DataFrame:
    """df with the columns, computed once: a one-row generator, which the optimizer neither
    merges into later projections nor lets filters repeat."""
    made = F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))
    return df.select("*", F.inline(made))


def _zone_names(spark) -> Column:
    names = [str(z) for z in spark._jvm.java.time.ZoneId.getAvailableZoneIds().toArray()]
    names = sorted(n for n in names if "/" in n or n in ("UTC", "GMT"))
    # One foldable literal, not a literal for each name.
    return F.str_to_map(F.lit(",".join(f"{n.lower()}={n}" for n in names)), F.lit(","), F.lit("="))
