"""Format-preserving pseudonyms for personal data, in DataFrame functions alone.

One pattern cuts a whole text into what it finds and what stands between. Validated values are permuted under a key
inside their own format by a Feistel network over two halves (l mod a, r mod b), so that a value has the same pseudonym
in every document, different values keep different pseudonyms, and who holds the key can go back:

    card numbers    Luhn-valid numbers become Luhn-valid numbers of the same length
    other numbers   13 to 19 digits become as many digits
    phone numbers   the country code and the punctuation stay; of national numbers the first digit, but for 3-3-4 digits
    IPv4 addresses  all 2**32 addresses among themselves
    IPv6 addresses  all 2**128 addresses among themselves, however they were shortened
    dates           real days of 1800 to 2199 among themselves, in the format they were written in; of dates with slashes
                    the month comes first, or else the day: such days (from the 13th on) among themselves
    SSN             numbers with valid area, group and serial among themselves

Mail addresses and long hexadecimal secrets have no small format to be permuted in; they become keyed digests (an
address at example.invalid; as many hexadecimal digits). Days that do not exist and invalid SSNs stay.

A null text stays null, an empty one empty; null ids are kept; repeated rows give repeated results. ``pseudonymise``
keeps all other columns; a column named like the count is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import query, table

ROUNDS = 10
KEY = "tabspark"  # production runs give their own

MAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)+"
HEX = r"(?<![A-Za-z0-9])[0-9a-fA-F]{32,}(?![A-Za-z0-9])"
OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
IP = rf"(?<![\d.])(?:{OCTET}\.){{3}}{OCTET}(?!\d|\.\d)"
GROUP = r"[0-9a-fA-F]{1,4}"
IP6 = (
    rf"(?<![0-9A-Za-z])(?=(?:{GROUP})?:(?:{GROUP})?:)(?:(?:{GROUP}:){{7}}{GROUP}|(?<!:)::{GROUP}(?::{GROUP}){{0,6}}|(?:{GROUP}:){{7}}:"
    + "".join(rf"|(?:{GROUP}:){{{n}}}(?::{GROUP}){{1,{7 - n}}}|(?:{GROUP}:){{{n}}}:" for n in range(6, 0, -1))
    + r")(?![0-9A-Za-z]|:[0-9a-fA-F:]|\.\d)"
)
DATE = r"(?<!\d)(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?!\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
PHONE = r"\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<!\d)\(\d{3}\) ?\d{3}-\d{4}(?!\d)"
NUMBER = r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)"
#: National phone numbers: 3-3-4 digits, perhaps behind a 1; 9 to 12 digits that start with 0; 9 digits as written in Spain.
NATIONAL = (
    "(?<!\\d)(?:"
    + "|".join(rf"(?:1{x})?\d{{3}}{x}\d{{3}}{x}\d{{4}}" for x in ("-", " ", r"\."))
    + r"|(?=0(?:[ ./-]{0,3}\d){8,11}(?!\d))0\d{1,4}(?:"
    + "|".join(rf"(?:{x}\d{{2,8}}){{1,5}}" for x in ("-", " ", r"\."))
    + r"| ?/ ?\d{2,8}(?:[ -]\d{2,8}){0,3})"
    + "|"
    + "|".join(rf"[6-9]\d{{2}}{x}\d{{3}}{x}\d{{3}}|[6-9]\d{{2}}(?:{x}\d{{2}}){{3}}|[89]\d{x}\d{{3}}(?:{x}\d{{2}}){{2}}" for x in ("-", " ", r"\."))
    + ")(?!\\d)"
)
PRIVATE = "|".join([MAIL, HEX, IP, IP6, DATE, SSN, PHONE, NUMBER, NATIONAL])
#: First day and number of days (400 years, 189 * 773) of the dates.
FIRST_DAY, DAY_HALVES = "1800-01-01", (189, 773)
#: Of them, those from the 13th of a month on (9 * 9833), which cannot be read with the month first.
LATE_HALVES = (9, 9833)
AREAS, GROUPS, SERIALS = 898, 99, 9999


def feistel(left: Column, right: Column, a: Column, b: Column, kind: str, key: str) -> Column:
    """struct(l, r): a keyed permutation of Z_a x Z_b."""

    def drawn(i: Column, value: Column, size: Column) -> Column:
        text = F.concat_ws("|", F.lit(key), F.lit(kind), a.cast("string"), b.cast("string"), i.cast("string"), value.cast("string"))
        return F.pmod(F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long"), size)

    def turn(s: Column, i: Column) -> Column:
        l, r = s["l"], s["r"]
        return F.when(i % 2 == 0, F.struct(((l + drawn(i, r, a)) % a).alias("l"), r.alias("r"))).otherwise(
            F.struct(l.alias("l"), ((r + drawn(i, l, b)) % b).alias("r"))
        )

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def _ten_to(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("long")


def permute_digits(digits: Column, kind: str, key: str) -> Column:
    """As many digits, permuted under the key."""
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    made = feistel(digits.substr(F.lit(1), half), digits.substr(half + 1, n - half), _ten_to(half), _ten_to(n - half), kind, key)
    return _let(made, lambda s: F.concat(F.lpad(s["l"].cast("string"), half, "0"), F.lpad(s["r"].cast("string"), n - half, "0")))


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def luhn_sum(digits: Column, doubled: int) -> Column:
    """Sum of the digits; of those an odd (``doubled`` = 1) or even (0) number of places from the end, twice the digit."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = digits.substr(i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when((n - i) % 2 == doubled, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def _refilled(shape: Column, digits: Column) -> Column:
    """The digits in the places that digits have in ``shape``."""

    def place(i: Column) -> Column:
        c = shape.substr(i, F.lit(1))
        k = F.length(F.regexp_replace(shape.substr(F.lit(1), i), "[^0-9]", ""))
        return F.when(c.rlike("^[0-9]$"), digits.substr(k, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(shape)), place), "")


def _number(m: Column, key: str) -> Column:
    def made(d: Column) -> Column:
        n = F.length(d)
        payload = permute_digits(d.substr(F.lit(1), n - 1), "card", key)
        card = _let(payload, lambda p: F.concat(p, ((10 - luhn_sum(p, 0) % 10) % 10).cast("string")))
        return F.when(luhn_sum(d, 1) % 10 == 0, card).otherwise(permute_digits(d, "number", key))

    return _let(F.regexp_replace(m, "[^0-9]", ""), lambda d: _let(made(d), lambda x: _refilled(m, x)))


def _phone(m: Column, key: str) -> Column:
    def made(d: Column) -> Column:
        code = F.when(m.startswith("+1"), 1).when(m.startswith("+"), 2).when(m.rlike(r"^(?:\(|\d{3}([ .-])\d{3}\1\d{4}$)"), 0).otherwise(1)
        return F.concat(d.substr(F.lit(1), code), permute_digits(d.substr(code + 1, F.length(d) - code), "phone", key))

    return _let(F.regexp_replace(m, "[^0-9]", ""), lambda d: _let(made(d), lambda x: _refilled(m, x)))


def _ip(m: Column, key: str) -> Column:
    def octet(s: Column, half: str, high: bool) -> Column:
        return (F.floor(s[half] / 256) if high else s[half] % 256).cast("long").cast("string")

    parts = F.split(m, r"\.")
    left, right = (parts[i].cast("long") * 256 + parts[i + 1].cast("long") for i in (0, 2))
    size = F.lit(65536).cast("long")
    return _let(feistel(left, right, size, size, "ip", key), lambda s: F.concat_ws(".", octet(s, "l", True), octet(s, "l", False), octet(s, "r", True), octet(s, "r", False)))


def _ip6(m: Column, key: str) -> Column:
    """Two halves of 64 bits, each mixed into the other; written as eight groups."""

    def number(hexadecimal: Column) -> Column:
        return F.conv(hexadecimal, 16, -10).cast("long")

    def turn(s: Column, i: Column) -> Column:
        l, r = s["l"], s["r"]
        drawn = lambda value: number(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("ip6"), i.cast("string"), value.cast("string")), 256), 1, 16))
        return F.struct(r.alias("l"), l.bitwiseXOR(drawn(r)).alias("r"))

    def groups(part: Column) -> Column:
        return F.filter(F.split(part, ":", -1), lambda g: g != "")

    def made(ends: Column) -> Column:
        left, right = groups(ends[0]), groups(F.coalesce(F.get(ends, F.lit(1)), F.lit("")))
        filled = F.concat(left, F.array_repeat(F.lit("0"), 8 - F.size(left) - F.size(right)), right)
        return F.array_join(F.transform(filled, lambda g: F.lpad(g, 4, "0")), "")

    def moved(x: Column) -> Column:
        start = F.struct(number(F.substring(x, 1, 16)).alias("l"), number(F.substring(x, 17, 16)).alias("r"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)

    def written(s: Column) -> Column:
        x = F.lower(F.concat(F.lpad(F.hex(s["l"]), 16, "0"), F.lpad(F.hex(s["r"]), 16, "0")))
        return _let(x, lambda x: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.regexp_replace(x.substr(4 * k + 1, F.lit(4)), "^0{1,3}", "")), ":"))

    return _let(_let(_let(F.split(m, "::", -1), made), moved), written)


def _late_date(m: Column, key: str) -> Column:
    """A day from the 13th on, written with the day first; null if it is none or outside the years."""
    a, b = (F.lit(x).cast("long") for x in LATE_HALVES)
    first = F.lit(FIRST_DAY).cast("date")

    def before(month: Column) -> Column:
        """Such days before a month, counted from the first one."""
        return F.datediff(F.add_months(first, month.cast("int")), first).cast("long") - 12 * month

    def day_of(k: Column) -> Column:
        near = F.floor(k * 4800 / (a * b)).cast("long")
        months = F.transform(F.array(*[F.lit(i).cast("long") for i in (-1, 0, 1)]), lambda i: near + i)
        month = F.array_max(F.filter(months, lambda x: before(x) <= k))
        return _let(month, lambda x: F.date_add(F.add_months(first, x.cast("int")), (12 + k - before(x)).cast("int")))

    def moved(day: Column) -> Column:
        month = (F.year(day) - 1800) * 12 + F.month(day) - 1
        k = before(month.cast("long")) + F.dayofmonth(day) - 13
        made = _let(_let(feistel(F.floor(k / b), k % b, a, b, "late date", key), lambda s: s["l"] * b + s["r"]), day_of)
        return F.when((F.year(day) >= 1800) & (F.year(day) < 2200) & (F.dayofmonth(day) > 12), F.date_format(made, "dd/MM/yyyy"))

    return _let(F.try_to_timestamp(m, F.lit("dd/MM/yyyy")).cast("date"), moved)


def _date(m: Column, key: str) -> Column:
    a, b = (F.lit(x).cast("long") for x in DAY_HALVES)
    first = F.lit(FIRST_DAY).cast("date")

    def written(form: str) -> Column:
        def moved(k: Column) -> Column:
            made = _let(feistel(F.floor(k / b), k % b, a, b, "date", key), lambda s: F.date_add(first, (s["l"] * b + s["r"]).cast("int")))
            return F.when((k >= 0) & (k < a * b), F.date_format(made, form))

        day = F.datediff(F.try_to_timestamp(m, F.lit(form)).cast("date"), first).cast("long")
        return F.coalesce(_let(day, moved), m)

    shapes = {r"^\d{4}-": "yyyy-MM-dd", r"^\d{4}/": "yyyy/MM/dd", r"^\d{2}\.": "dd.MM.yyyy", r"^\d{2}/": "MM/dd/yyyy"}
    out = m
    for shape, form in shapes.items():
        out = F.when(m.rlike(shape), written(form)).otherwise(out)
    return F.when(m.rlike(r"^(?:1[3-9]|[23]\d)/"), F.coalesce(_late_date(m, key), m)).otherwise(out)


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (m.substr(F.lit(i), F.lit(n)).cast("long") for i, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    left = (F.when(area > 666, area - 2).otherwise(area - 1)) * GROUPS + group - 1

    def written(s: Column) -> Column:
        k = F.floor(s["l"] / GROUPS).cast("long")
        pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
        return F.concat_ws("-", pad(F.when(k >= 665, k + 2).otherwise(k + 1), 3), pad(s["l"] % GROUPS + 1, 2), pad(s["r"] + 1, 4))

    made = feistel(left, serial - 1, F.lit(AREAS * GROUPS).cast("long"), F.lit(SERIALS).cast("long"), "ssn", key)
    return F.when(valid, _let(made, written)).otherwise(m)


def pseudonym(m: Column, key: str = KEY) -> Column:
    """What takes the place of one match."""
    digest = lambda kind, v: F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), v), 256)
    secret = F.substring(F.repeat(digest("hex", F.lower(m)), F.ceil(F.length(m) / 64).cast("int")), 1, 1 << 30).substr(F.lit(1), F.length(m))
    return (
        F.when(m.contains("@"), F.concat(F.lit("u"), F.substring(digest("mail", F.lower(m)), 1, 16), F.lit("@example.invalid")))
        .when(m.rlike("^[0-9a-fA-F]{32,}$"), secret)
        .when(m.rlike(rf"^(?:{OCTET}\.){{3}}{OCTET}$"), _ip(m, key))
        .when(m.contains(":"), _ip6(m, key))
        .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), _ssn(m, key))
        .when(m.rlike(r"^(?:\d{4}[-/]\d{2}[-/]\d{2}|\d{2}[./]\d{2}[./]\d{4})$"), _date(m, key))
        .when(m.rlike(r"^[+(]") | (F.length(F.regexp_replace(m, "[^0-9]", "")) < 13), _phone(m, key))
        .otherwise(_number(m, key))
    )


def pseudonymise(docs: DataFrame, key: str = KEY, text: str = "text", count: str | None = "n_private") -> DataFrame:
    """The rows with personal data in ``text`` replaced; ``count`` holds how many values were changed, if named."""
    t = F.col(f"`{text}`")
    may = t.rlike(r"[0-9@]|::|(?:[a-fA-F]{1,4}:){7}") | t.rlike(r"[0-9a-fA-F]{32}")
    found = F.when(may, F.regexp_extract_all(t, F.lit(f"({PRIVATE})"), F.lit(1))).otherwise(F.array().cast("array<string>"))
    cols = [c for c in docs.columns if c != count]
    parts = docs.select(*[F.col(f"`{c}`") for c in cols], F.struct(found.alias("old"), F.when(may, F.split(t, PRIVATE, -1)).alias("rest")).alias("_cut"))
    new = F.struct(
        F.col("_cut.old").alias("old"), F.col("_cut.rest").alias("rest"), F.transform("_cut.old", lambda m: pseudonym(m, key)).alias("new")
    )
    parts = parts.withColumn("_cut", F.when(F.size("_cut.old") > 0, new))
    joined = F.array_join(F.transform("_cut.rest", lambda s, i: F.concat(s, F.coalesce(F.get("_cut.new", i), F.lit("")))), "")
    changed = F.size(F.filter(F.arrays_zip(F.col("_cut.old").alias("o"), F.col("_cut.new").alias("n")), lambda p: p["o"] != p["n"]))
    out = [F.when(F.col("_cut").isNotNull(), joined).otherwise(t).alias(text) if c == text else F.col(f"`{c}`") for c in cols]
    counted = [F.coalesce(F.when(F.col("_cut").isNotNull(), changed), F.lit(0)).cast("long").alias(count)] if count else []
    return parts.select(*out, *counted)


@query("op6_pii_pseudonyms")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return pseudonymise(table(spark, folder, "documents").select("doc_id", "text"))
