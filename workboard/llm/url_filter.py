"""URL filter: host and path rules, and a path-template tree judged by smoothed purity (operator 7).

Rules (host and path) come first: the longest rule whose host is the url's host or a parent domain of it, and whose path
starts the url's path, decides. Every other url is judged by a template tree that is learnt from labelled pages.

Per host, a path is a sequence of segments, of any number and length. Digits and hexadecimal segments are variable and become
wildcards at once. The tree then grows level by level over counted shapes (not pages), as long as some node that goes on holds
labels enough for a branch to differ; what is deeper are wildcards. A literal branch is kept only if its bad pages are more, or
fewer, than chance deals it from its node; all other branches are statistically alike and are merged into one wildcard. A
url's template is its host and its generalised path.

The purity of a template is its share of bad pages, smoothed towards its host's share, which is smoothed towards the share of
all hosts of its domain (the host without its first label) and that towards the share of all pages. A template is rejected if
its smoothed purity reaches ``REJECT``, or ``LIFT`` times the odds of all pages where that is less, and its bad pages are more
than the share of all pages (at most ``REJECT``) gives by chance.

Chance is bounded in closed form at every size: of n pages drawn from a share q, at least (or at most) b are bad with a
probability of at most exp(-n KL(b/n, q)), with or without replacement. ``ERROR`` is shared out among all tests of a level,
or all templates, so that labels that have nothing to do with urls keep no branch and reject no template but by ``ERROR``.

All pages and all labels count. Trees are small tables (one row per host and shape), joined back to the pages.

Edge cases: a null url or one without ``://`` has empty host and path. Without labels nothing is blocked but by rules.
Repeated rows get equal results. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from workboard.llm.store import cut, small

#: Probability of any branch kept, or template rejected, by chance alone (by level, and for all templates).
ERROR = 0.01
STRENGTH = 10.0
REJECT, LIFT = 0.5, 3.0
#: Verdicts are broadcast only if their shapes hold at most this many characters.
BROADCAST_CHARS = 16_000_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) after the first ``://`` up to / ? # or the end, then the path up to ? # or the end."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.greatest(F.char_length(url), F.lit(1)))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.char_length(host) + 1, F.greatest(F.char_length(url), F.lit(1))),
                            "^[^?#]*", 0)
    known = url.isNotNull() & (at > 0)
    return (F.when(known, F.translate(host, _UPPER, _LOWER)).otherwise(""), F.when(known, path).otherwise(""))


def match_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest of ``rules`` (verdict, host, path) that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def shape(path: Column) -> Column:
    """Segments of a whole path with variable parts as wildcards."""
    def general(s: Column) -> Column:
        s = F.regexp_replace(s, "[0-9]+", "<n>")
        letters = F.translate(F.replace(s, F.lit("<n>"), F.lit("")), "abcdefABCDEF", "")
        return F.when((letters == "") & s.rlike("[a-fA-F]<n>"), "<hex>").otherwise(s)

    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), general)


def _share(bad: Column, n: Column, prior: Column) -> Column:
    return (bad + STRENGTH * prior) / (n + STRENGTH)


def _evidence(bad: Column, n: Column, share: Column) -> Column:
    """n KL(bad / n, share): the chance that ``share`` gives a count this far off is at most exp of its negative."""
    def part(k: Column, q: Column) -> Column:
        expected = F.greatest(n * q, F.lit(1e-300))
        return F.when(k > 0, k * F.ln(k / expected)).otherwise(0.0)

    return part(bad.cast("double"), share) + part((n - bad).cast("double"), 1 - share)


def _bound(tests: int) -> float:
    return math.log(max(tests, 1) / ERROR)


def grow(shapes: DataFrame) -> DataFrame:
    """(host, shape, template) for counted ``shapes`` (host, shape, pages, labelled, bad)."""
    rows = shapes.withColumn("template", F.lit(""))
    share = F.col("all_b") / F.greatest(F.col("all_n"), F.lit(1))
    # no branch of a node can be further off than one that holds all of its bad pages, or all of its good ones
    most = F.greatest(_evidence(F.col("all_b"), F.col("all_b"), share),
                      _evidence(F.lit(0), F.col("all_n") - F.col("all_b"), share))
    d = 0
    while not (rows.where(F.size("shape") > d).groupBy("host", "template")
               .agg(F.sum("labelled").alias("all_n"), F.sum("bad").alias("all_b")).where(most > _bound(2)).isEmpty()):
        here = F.get("shape", F.lit(d))
        branches = cut(rows.where(F.size("shape") > d).groupBy("host", "template", here.alias("seg")).agg(
            F.sum("labelled").alias("n"), F.sum("bad").alias("b")), "branches")
        whole = branches.groupBy("host", "template").agg(F.sum("n").alias("all_n"), F.sum("b").alias("all_b"))
        bound = _bound(2 * branches.where("n > 0").count())
        differs = (F.col("n") < F.col("all_n")) & (_evidence(F.col("b"), F.col("n"), share) > bound)
        token = (branches.join(whole, ["host", "template"])
                 .select("host", "template", "seg", F.when(differs, F.col("seg")).otherwise("*").alias("token")))
        longer = F.concat("template", F.lit("/"), F.coalesce("token", F.lit("*")))
        rows = cut(rows.withColumn("seg", here).join(cut(token, "tokens"), ["host", "template", "seg"], "left")
                   .select("host", "shape", "pages", "labelled", "bad",
                           F.when(F.size("shape") > d, longer).otherwise(F.col("template")).alias("template")), "tree")
        d += 1
    return rows.withColumn("template", F.concat("template", F.repeat(F.lit("/*"), F.greatest(F.size("shape") - d, F.lit(0)))))


def purities(tree: DataFrame) -> DataFrame:
    """(host, template, purity, rejected): smoothed share of bad pages, and whether it is rejected."""
    own = cut(tree.groupBy("host", "template").agg(F.sum("bad").alias("b"), F.sum("labelled").alias("n"))
              .withColumn("domain", F.regexp_replace("host", "^[^.]*[.](?=.*[.])", "")), "templates")
    tests, bad, labelled = own.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("b"), F.lit(0)),
                                   F.coalesce(F.sum("n"), F.lit(0))).first()
    base = bad / max(labelled, 1)
    odds = LIFT * base / (1 - base) if base < 1 else math.inf
    least = min(REJECT, odds / (1 + odds)) if base < 1 else REJECT
    chance = F.lit(min(base, REJECT))
    domains = own.groupBy("domain").agg(_share(F.sum("b"), F.sum("n"), F.lit(base)).alias("of_domain"))
    hosts = own.groupBy("host", "domain").agg(F.sum("b").alias("b"), F.sum("n").alias("n")).join(domains, "domain").select(
        "host", _share(F.col("b"), F.col("n"), F.col("of_domain")).alias("of_host"))
    purity = _share(F.col("b"), F.col("n"), F.col("of_host"))
    beyond = (F.col("b") > F.col("n") * chance) & (_evidence(F.col("b"), F.col("n"), chance) > _bound(tests))
    return own.join(hosts, "host").select("host", "template", purity.alias("purity"),
                                          (beyond & (purity >= least)).alias("rejected"))


def judge(pages: DataFrame, bad: Column, rules: list[tuple[str, str, str]], id_col: str = "page_id",
          url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) for every row of ``pages``.

    ``bad`` is true, false or null (not labelled) for each row; labels of all rows teach the tree.
    """
    host, path = host_and_path(F.col(url_col))
    seen = cut(pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"),
                            bad.cast("int").alias("bad")).withColumn("shape", shape(F.col("path"))), "urls")
    shapes = seen.groupBy("host", "shape").agg(F.count("*").alias("pages"), F.count("bad").alias("labelled"),
                                               F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    tree = grow(cut(shapes, "shapes"))
    verdicts = cut(tree.join(purities(tree), ["host", "template"]).select(
        "host", "shape", "template", "purity", "rejected"), "verdicts")
    chars = verdicts.agg(F.sum(F.length("host") + 2 * F.length(F.array_join("shape", "/")))).first()[0] or 0
    side = small(verdicts) if chars <= BROADCAST_CHARS else verdicts
    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    return (seen.drop("bad").join(side, ["host", "shape"], "left")
            .select("page_id", "host", "path", rule.alias("rule"),
                    F.coalesce(verdict, F.when(F.col("rejected"), "block").otherwise("allow")).alias("verdict"),
                    "template", "purity"))
