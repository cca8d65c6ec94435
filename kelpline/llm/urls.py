"""URL filters: host and path rules, and a logistic regression on hashed character n-grams for what no rule decides."""

from __future__ import annotations

import random
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.llm import linear

GRAMS = (3, 4, 5)  # characters
SLOTS = 1 << 14  # of the hashed n-grams
SEED = 7
RULES_AT_MOST = 256  # rules that become expressions of the plan; more are joined by the hosts' suffixes

#: Words of hosts, for the labelled table: what blocklists are about, by family, and what ordinary sites are about.
BLOCKED = {
    "gambling": "casino poker roulette blackjack jackpot slots bets betting wager lottery bingo bookmaker win bonus",
    "pharmacy": "pills viagra cialis pharmacy meds tablets steroids slimming dosage painkiller prescription",
    "adult": "adult porn xxx nude erotic escort webcam fetish hentai milf sexy",
    "advertising": "ads adserver advert banner tracker track tracking popunder popup pixel affiliate click impression",
    "spam": "spam clickbait linkfarm doorway bulkmail spammer autoblog backlinks traffic farm",
    "fraud": "phishing scam malware trojan keylogger ransom spyware botnet exploit hacked",
    "piracy": "warez crack keygen torrent serials pirated cracked nulled leech rapid",
    "money": "loan payday forex credit cash cheap replica free prize winner fakes discount millionaire",
}
ORDINARY = "library news school garden recipes weather museum travel docs wiki forum science music city radio press mail maps health kitchen history sports gallery theatre review journal archive village bakery cinema cycling university hospital church council gardening painting poetry physics biology chemistry language teacher student sailing hiking mountain river castle airport railway harbour market coffee books writing software compiler kernel database astronomy geology farming fishing football chess knitting pottery orchestra opera dance parish regional national institute foundation society education information translation construction fiction station nutrition conservation election production photography insurance planning engineering furniture clothes shoes toys horses birds flowers trees timber iron stone glass paper printing motor electric solar energy water ocean island camping hotel restaurant wine cheese bread fruit family children wedding doctor dentist clinic lawyer budget office studio design fashion jewellery workshop factory machine robot network server internet telephone television video camera film story legend religion philosophy psychology economics politics democracy justice peace army navy border country town street square bridge tower house roof window door table chair lamp".split()
_LABELS = "www m blog shop news mail app static cdn img old my home web2 dev".split()
_ENDINGS = "com net org info biz co.uk de fr it es io eu ca us nl se pl".split()
_PATHS = "index home page view post story item product list topic thread user about archive tag p n id article watch go out r download".split()


def labelled(n: int = 600, without: str | None = None) -> list[tuple[str, int]]:
    """The labelled table: n URLs to block (1), as many of each family but `without`, and 3 n ordinary ones (0). Their hosts come from the words
    above, alone or in pairs, the ordinary ones also from letters; what goes before and after is drawn alike for both, so that it
    tells nothing."""
    rng = random.Random(SEED)
    families = [v.split() for k, v in BLOCKED.items() if k != without]
    every = [w for f in families for w in f]

    def url(name: str) -> str:
        path = "".join(f"/{rng.choice([rng.choice(_PATHS), str(rng.randrange(10 ** rng.randint(1, 6)))])}" for _ in range(rng.randint(0, 3)))
        rest = rng.choice(["", "", "/", ".html", ".php", f"?{rng.choice(_PATHS)}={rng.randrange(1000)}", f"#{rng.choice(_PATHS)}"])
        label = f"{rng.choice(_LABELS)}." if rng.random() < 0.4 else ""
        return f"{rng.choice(['http', 'https'])}://{label}{name}.{rng.choice(_ENDINGS)}{path}{rest if path else ''}"

    def join(words: list[str]) -> str:
        return rng.choice(["-", "-", ""]).join(words) + (str(rng.randrange(100)) if rng.random() < 0.15 else "")

    def invented() -> str:
        return "".join(rng.choice("bcdfghklmnprstvwz") + rng.choice("aeiouy") + rng.choice(["", "", *"nrstlhd"]) if rng.random() < 0.6 else rng.choice("abcdefghijklmnoprstuvwyz") + rng.choice("abcdefghijklmnoprstuvwyz") for _ in range(rng.randint(2, 5)))

    rows = []
    for k in range(n):
        own = rng.choice(families[k % len(families)])
        rows.append((url(join([own, rng.choice(every)] if k // len(families) % 2 else [own])), 1))
    for k in range(3 * n):
        name = join(rng.sample(ORDINARY, 1 + k // 4 % 2)) if k % 2 else invented()
        rows.append((url(name), 0))
    return rows


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    """Host: what is between the first `://` and the next `/`, `?`, `#` or the end, A-Z lower-cased. Path: from there to `?`, `#` or
    the end. Null, or no `://`: both empty."""
    rest = f"case when instr(`{url}`, '://') > 0 then substr(`{url}`, instr(`{url}`, '://') + 3) else '' end"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.translate(F.regexp_extract(F.expr(rest), "^[^/?#]*", 0), upper, upper.lower())
    return host, F.regexp_extract(F.expr(rest), "^[^/?#]*([^?#]*)", 1)


def _slots(host: str, path: str) -> Column:
    """The slots of all n-grams of a host and of a path; those of one aren't those of the other."""
    each = []
    for kind, c in (("h", host), ("p", path)):
        for n in GRAMS:
            each.append(f"transform(sequence(1, greatest(1, length({c}) - {n - 1})), i -> pmod(xxhash64('{kind}', substr({c}, i, {n})), {SLOTS}L))")
    return F.expr(f"concat({', '.join(each)})")


@lru_cache(maxsize=16)
def _model(spark: SparkSession, without: str | None = None) -> tuple[str, float]:
    """Weights of the slots, as text, and the bias; trained once in a session from labelled()."""
    rows = spark.createDataFrame(labelled(without=without), "url string, label int")
    host, path = host_and_path()
    found = rows.select("label", host.alias("host"), path.alias("path")).select("label", _slots("host", "path").alias("slots")).collect()  # a row for each labelled
    w, b = linear.fit_sparse([r.slots for r in found], np.array([r.label for r in found]), SLOTS)
    return ",".join(repr(round(v, 6)) for v in w.tolist()), b


def score(spark: SparkSession, host: str = "host", path: str = "path", without: str | None = None) -> Column:
    """The model's probability that a URL is to be blocked. without: a family that it isn't trained on, to see how it does on words it
    has never met."""
    weights, bias = _model(spark, without)
    total = F.aggregate(_slots(host, path), F.lit(bias), lambda a, s: a + F.element_at(F.split(F.lit(weights), ",").cast("array<double>"), (s + 1).cast("int")))
    return 1 / (1 + F.exp(-total))


def rule_for(rules: list[tuple[str, str, str]], host: str = "host", path: str = "path") -> Column:
    """rules (verdict, host, path): the longest that fits, as a struct of rule and verdict; null if none does. A rule fits its host and
    all sub-domains, if the path begins with its path. Of equally long ones the first in the list wins."""
    fits = []
    for verdict, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        here = (F.col(host) == h) | F.endswith(F.col(host), F.lit("." + h))
        fits.append(F.when(here & F.startswith(F.col(path), F.lit(p)), F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule: string, verdict: string>")


def with_rules(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """rows (host, path, …) and rules (verdict, host, path, place: which of equally long ones wins, the least). Adds fit, as rule_for(), for any
    number of rules: each different host's suffixes are joined to the rules' hosts once, and a row looks among its host's rules. A host has
    as few suffixes as dots; rules of one host are kept together."""
    each = rules.groupBy(F.col("host").alias("suffix")).agg(F.collect_list(F.struct("path", "verdict", "host", "place")).alias("rules"))
    hosts = rows.select("host").distinct()
    suffixes = F.expr("transform(sequence(1, size(split(host, '[.]'))), i -> array_join(slice(split(host, '[.]'), i, size(split(host, '[.]'))), '.'))")
    found = hosts.select("host", F.explode(suffixes).alias("suffix")).join(each, "suffix")
    found = found.groupBy(F.col("host").alias("r_host")).agg(F.flatten(F.collect_list("rules")).alias("rules"))
    best = F.array_max(F.transform(F.filter("rules", lambda r: F.startswith(F.col("path"), r.path)), lambda r: F.struct(F.length(F.concat(r.host, r.path)).alias("n"), (-r.place).alias("p"), F.concat(r.host, r.path).alias("rule"), r.verdict.alias("verdict"))))
    out = rows.join(found, F.col("host") == F.col("r_host"), "left").withColumn("best", best)
    return out.select(*rows.columns, F.when(F.col("best").isNotNull(), F.struct(F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))).alias("fit"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """pages (page_id, url, …). Returns a row for each row of pages: page_id, host, path, rule, score, verdict. The verdict is the
    rule's, or else block where the score is over a half. Up to RULES_AT_MOST rules nothing is shuffled. Null or empty URLs have empty hosts
    and paths, which no rule fits; the model judges them like others. URLs of any length are read whole; repeated rows are judged
    each; of equally long rules the first wins; an empty table gives an empty result; other columns aren't looked at."""
    host, path = host_and_path()
    spark = pages.sparkSession
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    if len(rules) <= RULES_AT_MOST:
        rows = rows.withColumn("fit", rule_for(rules))
    else:
        rows = with_rules(rows, spark.createDataFrame([(*r, k) for k, r in enumerate(rules)], "verdict string, host string, path string, place int"))
    rows = rows.withColumn("score", score(spark))
    own = F.when(F.col("score") > 0.5, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), "score", F.coalesce(F.col("fit.verdict"), own).alias("verdict"))
