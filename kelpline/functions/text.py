"""Text functions: URLs, sizes, previews, typed inference, metric lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def percent_encode(s: str | Column) -> Column:
    """RFC 3986: unreserved characters stay, all other bytes become upper-case hex."""
    form = F.url_encode(_c(s))
    return F.replace(F.replace(F.replace(form, F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def url_base(host: str | Column) -> Column:
    """A host or URL with a scheme (http if it has none) and without slashes at its end."""
    trimmed = F.regexp_replace(_c(host), "/+$", "")
    return F.when(F.contains(trimmed, F.lit("://")), trimmed).otherwise(F.concat(F.lit("http://"), trimmed))


def archiver_url(host: str | Column, pv: str | Column, begin: str | Column, end: str | Column) -> Column:
    """The retrieval request of one source; without an end the window is open."""
    tail = F.when(_c(end).isNotNull(), F.concat(F.lit("&to="), percent_encode(end))).otherwise("")
    return F.concat(url_base(host), F.lit("/retrieval/data/getData.raw?pv="), percent_encode(pv), F.lit("&from="), percent_encode(begin), tail)


def preview_list(items: str | Column, n: int = 3) -> Column:
    """The first items, and how many more there are; `-` for none."""
    size = F.size(_c(items))
    more = F.when(size > n, F.concat(F.lit(", +"), (size - n).cast("string"), F.lit(" more"))).otherwise("")
    return F.when(F.coalesce(size, F.lit(0)) <= 0, "-").otherwise(F.concat(F.array_join(F.slice(_c(items), 1, n), ", "), more))


def format_bytes(n: str | Column) -> Column:
    """In steps of 1024: bytes without decimals, larger units with two; ties go to the even digit."""
    v = _c(n).cast("double")
    out = F.format_string("%.0f B", F.rint(v))
    for k, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(v >= float(1024**k), F.format_string(f"%.2f {unit}", F.bround(v / float(1024**k), 2))).otherwise(out)
    return out


def infer_scalar(token: str | Column) -> tuple[Column, Column, Column, Column]:
    """(kind, boolean, long, double) of a token: true or false in any case, else a whole integer, else a whole number, else a string."""
    t = _c(token)
    is_bool = F.lower(t).isin("true", "false")
    whole = F.when(F.rlike(t, F.lit(r"^[+-]?[0-9]+$")), t.try_cast("long"))
    number = F.when(F.rlike(t, F.lit(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$")), t.try_cast("double"))
    kind = F.when(is_bool, "bool").when(whole.isNotNull(), "int64").when(number.isNotNull(), "double").otherwise("string")
    return kind, F.when(is_bool, F.lower(t) == "true"), F.when(~is_bool, whole), F.when(~is_bool & whole.isNull(), number)


def request_id(start: str | Column, root: str | Column, n: str | Column) -> Column:
    return F.concat_ws("_", F.lit("pv_stream"), _c(start).cast("string"), _c(root), _c(n).cast("string"))


def provider(pv: str | Column) -> tuple[Column, Column]:
    """(provider, name) of a source given with `pva://` or `ca://` before it; pva where it has neither."""
    p = _c(pv)
    return F.when(F.startswith(p, F.lit("ca://")), "ca").otherwise("pva"), F.regexp_replace(p, "^(pva|ca)://", "")


def metric_line(line: str | Column) -> tuple[Column, Column, Column, Column]:
    """(name, reader label, source label, value) of a line of exposition text; a value that isn't a number is 0, a missing label empty."""
    t = _c(line)
    label = lambda k: F.regexp_extract(t, rf'[{{,]{k}="([^"]*)"', 1)
    return F.regexp_extract(t, r"^([a-zA-Z_:][a-zA-Z0-9_:]*)", 1), label("reader"), label("source"), F.coalesce(F.regexp_extract(t, r"\s(\S+)\s*$", 1).try_cast("double"), F.lit(0.0))


def plain_number(t: str | Column) -> Column:
    """The text of a double as SQL has it, from Java's, which has an exponent from 10^7 up and under 0.001: plain digits from 0.0001 to below 10^16
    (5.5E7: 55000000.0), else an exponent with its sign and two digits or more (1.0E16: 1e+16). Other texts stay. The digits are Java's; before
    Java 19 these may be one or two more than needed from 10^16 up."""
    form = r"^(-?\d\.\d+)E(-?\d+)$"
    digits, e = F.regexp_extract(_c(t), form, 1), F.regexp_extract(_c(t), form, 2).try_cast("int")
    plain = F.regexp_replace(_c(t).try_cast("decimal(38,21)").cast("string"), r"(\.\d+?)0+$", "$1")
    power = F.concat(F.regexp_replace(digits, r"\.0$", ""), F.lit("e"), F.format_string("%+03d", e))
    return F.when(e.between(-4, 15), plain).when(e.isNotNull(), power).otherwise(_c(t))
