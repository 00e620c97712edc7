"""Personal data: base patterns, and candidate spans judged by boosted trees (operator 6, DataFrame functions only).

Base spans (always kept) are the leftmost non-overlapping matches of four patterns that pass their check: e-mail
addresses, dotted IP addresses with parts up to 255, card numbers of 14 to 19 digits passing Luhn's check, and
international phone numbers of 10 to 15 digits. High-recall generators propose further, overlapping spans: anything
around an ``@`` or a spelt-out "at", any long run of digits and separators, and of a run of several digit groups every
sub-run of at most ``GROUPS`` whole groups with 10 to 19 digits (so proposals stay linear in the text).

A candidate that alone would be a base span (a whole group or four groups of four passing Luhn's check, a number after
``+``) is accepted. For the others, boosted trees for each likely kind score the context (neighbouring characters, words
before it; for cards, where the base rule can match every form, the format too). They never see what defines a base
rule: no ``+``, no ``@``, no checksum, and not whether base matched the form. They are fitted on all texts but
one in ``FOLDS`` (by a hash of the text), base spans against decoys: numbers that can be no phone number, cards failing their check, addresses with
another short word than "at" in the brackets. All of these are counted by feature vector in Spark, so what reaches the
driver is at most the size of the feature grid. The threshold of a kind is calibrated on the texts held
out: the lowest score at which ``PRECISION`` of their base spans and decoys above are base spans and, for phone numbers and addresses, the decoys let expect at most
1 - ``PRECISION`` random ones among the other candidates above. Overlapping accepted candidates are resolved by score;
of one that touches a base span, the uncovered rest is added.

The patterns are written so that Java's matcher needs no recursion and no second look at a run of characters
(possessive loops, and a look-behind or the end of the last match in front), with the same matches as the plain ones;
long texts without white space stay linear. Text is looked at whole. Offsets are code points, the end exclusive.

Edge cases: null text counts as empty and has no spans. Repeated rows get equal results. A null id stays null. An empty
table gives no rows. With no candidates, nothing is added. Other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from workboard.llm.store import cut
from workboard.llm.trees import boost, column, predict

KINDS = ["email", "ip", "card", "phone"]

_LOCAL = "[A-Za-z0-9._%+-]"
#: Same matches as the published patterns; see the module text.
BASE = {
    "email": f"(?:(?<!{_LOCAL})|\\G){_LOCAL}++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": "(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++",
    # only runs of 14 to 19 digits: a maximal run is exactly one match of the plain pattern
    "card": "(?<![0-9])(?<![0-9][\\x20-])[0-9](?:[\\x20-]?[0-9]){13,18}+(?![\\x20-]?[0-9])",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
}

GENERATORS = {
    # something at something dot something, with the signs spelt out or spaced
    "email": "(?:(?<![A-Za-z0-9._%+-])|\\G)[A-Za-z0-9._%+-]++(?: ?@ ?| ?[\\[(](?:at|AT)[\\])] ?)"
             "[A-Za-z0-9-]++(?:(?: ?[\\[(](?:dot|DOT)[\\])] ?|\\.)[A-Za-z0-9-]++)++",
    "number": "(?:\\+|(?<![0-9])(?<![0-9][\\x20().-])\\(?)[0-9](?:[\\x20().-]{0,2}[0-9]){7,}+",
    # never an address: another short word in the brackets
    "decoy": "(?:(?<![A-Za-z0-9._%+-])|\\G)[A-Za-z0-9._%+-]++ ?[\\[(](?!at[\\])]|AT[\\])])[A-Za-z]{1,3}[\\])] ?"
             "[A-Za-z0-9-]++(?:(?: ?[\\[(](?:dot|DOT)[\\])] ?|\\.)[A-Za-z0-9-]++)++",
}
#: Digits of a sub-run of a number run (fewer have no likely kind), and the most groups it may have.
PART, GROUPS = range(10, 20), 8

#: Words within this many characters before a candidate are its context.
CONTEXT = 24
_CONTEXTS = ["(?i)mail|contact|write", "(?i)tel|phone|call|fax|mobile", "(?i)card|visa|credit|pay",
             "(?i)\\bip\\b|host|server", "(?i)token|key|password|secret|hash|version|order|isbn"]
PRECISION = 0.98
ROUNDS = 20
#: One text in this many calibrates the thresholds and teaches no tree.
FOLDS = 4
ROLES = ("hit", "other", "decoy")

_SPAN = "array<struct<kind:string,start:int,end:int,s:string>>"


def _none() -> Column:
    return F.array().cast(_SPAN)


def _matches(text: Column, kind: str, pattern: str) -> Column:
    """All matches as (kind, start, end, s). The pieces between matches give the offsets."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    before = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    steps = F.zip_with(before, found, lambda b, m: F.struct(F.char_length(b).alias("gap"), m.alias("s")))

    def add(acc, x):
        start = acc["pos"] + x["gap"]
        end = start + F.char_length(x["s"])
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), x["s"].alias("s"))
        return F.struct(end.alias("pos"), F.concat(acc["out"], F.array(span)).alias("out"))

    empty = F.struct(F.lit(0).alias("pos"), _none().alias("out"))
    spans = F.aggregate(steps, empty, add, lambda acc: acc["out"])
    return F.when(F.rlike(text, F.lit(pattern)), spans).otherwise(_none())


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(s: Column) -> Column:
    """Whether the digits of ``s`` (fewer than 20) pass Luhn's check: every second digit from the right is doubled."""
    d = F.reverse(_digits(s))

    def add(acc, i):
        x = F.substring(d, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return acc + x - F.when(x > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add) % 10 == 0


def _small_part(x: Column) -> Column:
    plain = F.regexp_replace(x, "^0+", "")
    return (F.length(plain) <= 3) & (F.coalesce(plain.try_cast("int"), F.lit(0)) <= 255)


_CHECKS = {
    "email": None,
    "ip": lambda m: F.forall(F.split(m["s"], "\\."), _small_part),
    "card": lambda m: F.length(_digits(m["s"])).between(14, 19) & _luhn(m["s"]),
    "phone": lambda m: F.length(_digits(m["s"])).between(10, 15),
}


def base_spans(text: Column) -> Column:
    """Base spans of ``text`` (not null), ordered by start and then kind as listed."""
    parts = []
    for k in KINDS:
        found = _matches(text, k, BASE[k])
        if k == "email":
            found = F.when(F.contains(text, F.lit("@")), found).otherwise(_none())
        parts.append(F.filter(found, _CHECKS[k]) if _CHECKS[k] else found)
    return _in_order(F.concat(*parts))


def _kind_rank(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in KINDS]), kind).cast("int")


def _in_order(spans: Column) -> Column:
    ranked = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), _kind_rank(x["kind"]).alias("rank"),
                                                   x["end"].alias("end"), x["kind"].alias("kind"), x["s"].alias("s")))
    return F.transform(F.array_sort(ranked), lambda x: F.struct(
        x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["s"].alias("s"))).cast(_SPAN)


#: Feature -> number of its values; their product bounds what is collected. The first three are format, for cards only.
GRID = {"digits": 21, "dots": 5, "gaps": 6, "left": 4, "right": 4, "context": 6}
FORMAT = 3
#: The features that make a form: digits and gaps.
FORM = [0, 2]


def _char_class(c: Column) -> Column:
    """0: an end of the text or white space, 1: a letter or digit, 2: punctuation of prose, 3: anything else."""
    return (F.when(c.rlike("^\\s?$"), 0).when(c.rlike("^[\\p{L}\\p{N}]$"), 1)
            .when(c.rlike("^[.,;:!?()\\[\\]'\"]$"), 2).otherwise(3))


def _count(s: Column, unwanted: str) -> Column:
    return F.length(F.regexp_replace(s, unwanted, ""))


def _before(text: Column, c: Column) -> Column:
    return F.when(c["start"] > 0, F.substring(text, F.greatest(c["start"] - CONTEXT + 1, F.lit(1)),
                                              F.least(c["start"], F.lit(CONTEXT)))).otherwise("")


def _features(c: Column) -> dict[str, Column]:
    s, before = c["s"], c["before"]
    context = F.lit(0)
    for i, words in reversed(list(enumerate(_CONTEXTS))):
        context = F.when(before.rlike(words), i + 1).otherwise(context)
    left = F.right(before, F.lit(1))
    return {
        "digits": F.least(_count(s, "[^0-9]"), F.lit(20)), "dots": F.least(_count(s, "[^.]"), F.lit(4)),
        "gaps": F.least(_count(s, "[^\\x20()-]"), F.lit(5)), "left": _char_class(left),
        "right": _char_class(c["after"]), "context": context,
    }


def _overlaps(spans: Column, c: Column) -> Column:
    return F.exists(spans, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


_FOUND = ["kind", "start", "end", "s", "before", "after", "edge"]


def _parts(text: Column, run: Column) -> Column:
    """Proper sub-runs of whole digit groups of a number run, with what stands beside them.

    ``edge`` tells whether the groups beside it are apart from it: it lies at an end of the run, or neither neighbour
    is a group of four.
    """
    size = F.char_length(run["s"])

    def of(x: Column) -> Column:
        chars, lead = x["chars"], x["lead"]  # the run from lead + 1 to lead + size, looked up without a scan of the text
        char = lambda p: F.element_at(chars, F.greatest(p, F.lit(1)))
        digit = lambda p: char(p).between("0", "9")
        piece = lambda a, n: F.array_join(F.slice(chars, a, n), "")
        firsts = F.filter(F.sequence(lead + 1, lead + size), lambda p: digit(p) & ((p == lead + 1) | ~digit(p - 1)))

        def at(p: Column) -> Column:
            sign = F.when((p > lead + 1) & char(p - 1).isin("+", "("), 1).otherwise(0)
            window = piece(p, F.least(F.lit(3 * max(PART) + 8), lead + size + 1 - p))

            def ends(w: Column) -> Column:
                found = F.array(*[F.regexp_extract(w, f"^[0-9](?:[\\x20().-]{{0,2}}[0-9]){{{k - 1}}}(?![0-9])", 0) for k in PART])
                few = F.filter(found, lambda m: (m != "") & ~m.rlike(f"^(?:[0-9]++[^0-9]++){{{GROUPS}}}"))

                def span(m: Column) -> Column:
                    first, past = p - sign, p + F.length(m)  # places in chars
                    start = run["start"] + first - lead - 1
                    before = piece(F.greatest(first - CONTEXT, F.lit(1)), F.least(first - 1, F.lit(CONTEXT)))
                    return F.struct(
                        F.lit("number").alias("kind"), start.alias("start"), (start + past - first).alias("end"),
                        F.when(sign == 1, F.concat(char(p - 1), m)).otherwise(m).alias("s"), before.alias("before"),
                        piece(past, F.lit(1)).alias("after"),
                        ((first == lead + 1) | (past == lead + size + 1)
                         | ~(before.rlike("(^|[^0-9])[0-9]{4}[^0-9]+$")
                             | F.substring(w, F.length(m) + 1, F.lit(8)).rlike("^[^0-9]+[0-9]{4}([^0-9]|$)"))).alias("edge"))

                return F.transform(few, span)

            return _let(window, ends)

        return F.filter(F.flatten(F.transform(firsts, at)), lambda c: (c["start"] > run["start"]) | (c["end"] < run["end"]))

    lead = _before(text, run)
    around = F.concat(lead, run["s"], F.substring(text, run["end"] + 1, F.lit(1)))
    return F.when(run["s"].rlike("[0-9][^0-9]+[0-9]"), _let(
        F.struct(F.split(around, "").alias("chars"), F.char_length(lead).alias("lead")), of)).otherwise(
        F.array().cast("array<struct<kind:string,start:int,end:int,s:string,before:string,after:string,edge:boolean>>"))


def _likely(c: Column, f: dict[str, Column]) -> Column:
    """What a candidate can be, by form; null: nothing."""
    plus = F.startswith(c["s"], F.lit("+"))
    return (F.when(c["kind"].isin("email", "decoy"), "email")
            .when((f["dots"] == 3) & (f["gaps"] == 0) & ~plus & (f["digits"] <= 12), "ip")
            .when(~plus & f["digits"].between(14, 19), "card")
            .when(f["digits"].between(10, 13) | (plus & f["digits"].between(14, 15)), "phone"))


def candidates(text: Column, base: Column) -> Column:
    """Candidate spans: what they may be, features, and what the base rules say of them.

    ``known``: touches a base span; ``fits``: would be a base span if it stood alone; ``role``: ``hit`` (a base span of
    its kind), ``decoy`` (can be none), ``other``, or null for a sub-run, which is not learnt from.
    """
    wide = lambda found: F.transform(found, lambda c: F.struct(
        *[c[x].alias(x) for x in _FOUND[:4]], _before(text, c).alias("before"),
        F.substring(text, c["end"] + 1, F.lit(1)).alias("after"), F.lit(True).alias("edge"), F.lit(True).alias("whole")))
    runs = _matches(text, "number", GENERATORS["number"])
    spelt = F.when(F.contains(text, F.lit("@")) | F.rlike(text, F.lit("(?:at|AT)[\\])]")),
                   _matches(text, "email", GENERATORS["email"])).otherwise(_none())
    decoys = F.when(F.rlike(text, F.lit("[\\[(][A-Za-z]{1,3}[\\])]")),
                    _matches(text, "decoy", GENERATORS["decoy"])).otherwise(_none())

    def numbers(found: Column) -> Column:
        parts = F.transform(F.flatten(F.transform(found, lambda run: _parts(text, run))), lambda c: F.struct(
            *[c[x].alias(x) for x in _FOUND], F.lit(False).alias("whole")))
        return F.concat(wide(found), parts)

    def judged(c: Column) -> Column:
        f = _features(c)

        def finish(x: Column) -> Column:
            luhn = F.when(x["likely"] == "card", _luhn(c["s"])).otherwise(False)
            form = c["s"].rlike("^([0-9]{14,19}|[0-9]{4}([\\x20-][0-9]{4}){3})$")
            fits = F.coalesce(((x["likely"] == "card") & luhn & form & (c["edge"] | ~c["s"].rlike("[^0-9]")))
                              | ((x["likely"] == "phone") & F.startswith(c["s"], F.lit("+"))), F.lit(False))
            hit = F.exists(base, lambda b: (b["kind"] == x["likely"]) & (b["start"] < c["end"]) & (c["start"] < b["end"]))
            role = (F.when(~c["whole"], F.lit(None).cast("string")).when(c["kind"] == "decoy", "decoy").when(hit, "hit")
                    .when(x["known"], F.lit(None).cast("string"))
                    .when(x["likely"].isNull() | (x["likely"] == "ip") | ((x["likely"] == "card") & ~luhn), "decoy")
                    .otherwise("other"))
            return F.struct(x["likely"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["s"].alias("s"),
                            x["known"].alias("known"), (fits & (c["kind"] == "number")).alias("fits"), role.alias("role"),
                            (c["kind"] != "decoy").alias("real"), *[x[k].alias(k) for k in GRID])

        return _let(F.struct(_likely(c, f).alias("likely"), _overlaps(base, c).alias("known"),
                             *[v.alias(k) for k, v in f.items()]), finish)

    return F.transform(F.concat(wide(spelt), wide(decoys), _let(runs, numbers)), judged)


@dataclass
class Judge:
    """For each kind: boosted trees over the feature grid, and a threshold of their margin (no entry: adds nothing).

    ``forms`` holds the share of each (digits, gaps) among the base spans of a kind; it ranks overlapping candidates.
    """
    models: dict = field(default_factory=dict)
    thresholds: dict = field(default_factory=dict)
    forms: dict = field(default_factory=dict)

    def margin(self, c: Column) -> Column:
        out = F.lit(0.0)
        for kind, (base, trees) in self.models.items():
            x = [c[k].cast("double") for k in GRID]
            own = F.lit(base)
            for t in trees:
                own = own + column(t, x)
            out = F.when(c["kind"] == kind, own).otherwise(out)
        return out

    def accepts(self, c: Column) -> Column:
        out, margin = F.lit(False), self.margin(c)
        for kind, least in self.thresholds.items():
            out = F.when(c["kind"] == kind, margin >= F.lit(least)).otherwise(out)
        return c["real"] & c["kind"].isNotNull() & (c["fits"] | out)

    def form(self, c: Column) -> Column:
        if not self.forms:
            return F.lit(0.0)
        known = F.create_map(*[F.lit(x) for k in sorted(self.forms) for x in (k, self.forms[k])])
        key = F.concat_ws(":", c["kind"], c["digits"].cast("string"), c["gaps"].cast("string"))
        return F.coalesce(F.try_element_at(known, key), F.lit(0.0))


def _held(text: Column) -> Column:
    """Whether a text's candidates calibrate the thresholds (one text in ``FOLDS``); copies of a text stay together."""
    return F.pmod(F.xxhash64(F.coalesce(text, F.lit(""))), F.lit(FOLDS)) == 0


def fit(found: DataFrame) -> Judge:
    """Fit on ``found`` (candidates: array of candidate structs, held): counted by feature vector in Spark, all of them.

    Trees learn from the texts that are not held, thresholds come from the held ones alone. A kind without base spans on
    either side gets no threshold.
    """
    # format counts for cards, and for the forms of base spans: other cells are few
    kept = F.expr("c.kind = 'card' or c.role = 'hit'")
    features = [F.when(kept, F.col(f"c.{k}")).otherwise(0).alias(k) if i < FORMAT else F.col(f"c.{k}")
                for i, k in enumerate(GRID)]
    rows = (found.select("held", F.explode("candidates").alias("c")).where("c.role is not null")
            .select("held", "c.kind", "c.role", *features)
            .groupBy("held", "kind", "role", *GRID).count().orderBy("held", "kind", "role", *GRID).collect())
    of_kind = np.array([KINDS.index(r["kind"]) if r["kind"] else -1 for r in rows], dtype=int)
    of_role = np.array([ROLES.index(r["role"]) for r in rows], dtype=int)
    held = np.array([r["held"] for r in rows], dtype=bool)
    every = np.array([[r[k] for k in GRID] for r in rows], dtype=float).reshape(-1, len(GRID))
    count = np.array([r["count"] for r in rows], dtype=float)
    judge = Judge()
    for at, kind in enumerate(KINDS):
        hits = (of_kind == at) & (of_role == 0)
        for form in np.unique(every[hits][:, FORM], axis=0).tolist():
            same = hits & (every[:, FORM] == form).all(axis=1)
            judge.forms[f"{kind}:{form[0]:.0f}:{form[1]:.0f}"] = float(count[same].sum() / count[hits].sum())
        if not (hits & held).any() or not (hits & ~held).any():
            continue
        others = (of_kind == at) & (of_role == 1)
        # a number of no kind, or failing the check of its kind, is a random number also for phones
        like = [KINDS.index("card"), KINDS.index("ip"), -1] if kind == "phone" else [at]
        decoys = (of_role == 2) & np.isin(of_kind, like)
        if kind == "phone" and not decoys.any():
            decoys = others
        x = every.copy()
        if kind != "card":
            x[:, :FORMAT] = 0
        wanted = hits | others | decoys
        cells, inverse = np.unique(x[wanted], axis=0, return_inverse=True)
        cell = np.zeros(len(x), int)
        cell[wanted] = inverse.ravel()

        def counts(part: np.ndarray) -> np.ndarray:
            return np.bincount(cell[part], count[part], len(cells))  # noqa: B023

        # one decoy is spread over all cells, so that cells without any base span score low
        weight = np.concatenate([counts(hits & ~held), counts(decoys & ~held) + 1 / len(cells)])
        base, trees = boost(np.concatenate([cells, cells]), np.repeat([1.0, 0.0], len(cells)), weight, rounds=ROUNDS, depth=3)
        margin = base + sum(predict(t, cells) for t in trees)
        levels, group = np.unique(-margin, return_inverse=True)  # falling margins, equal ones together
        own, other, decoy = (np.bincount(group, counts(p & held), len(levels)) for p in (hits, others, decoys))
        hit, other, decoy = np.cumsum(own), np.cumsum(other), np.cumsum(decoy)
        good = (own > 0) & (hit >= PRECISION * (hit + decoy))
        if kind in ("email", "phone"):
            # as many random ones of this form are expected as the decoys' share above tells; each bracketed decoy is one
            scale = 1.0 if kind == "email" else other[-1] / max(decoy[-1], 1.0)
            good &= decoy * scale <= (1 - PRECISION) * other
        good = np.flatnonzero(good)
        if len(good):
            # halfway to the next level, so that rounding of sums cannot move a candidate across
            k = good[-1]
            nxt = -levels[k + 1] if k + 1 < len(levels) else -levels[k] - 1.0
            judge.models[kind] = (float(base), trees)
            judge.thresholds[kind] = float((-levels[k] + nxt) / 2)
    return judge


def _located(docs: DataFrame, text: Column) -> DataFrame:
    """``docs`` with ``__base`` and ``__candidates``."""
    out = docs.withColumn("__text", F.coalesce(text, F.lit(""))).withColumn("__base", base_spans(F.col("__text")))
    return out.withColumn("__candidates", candidates(F.col("__text"), F.col("__base")))


def _rest(base: Column, c: Column) -> Column:
    """The parts of ``c`` that no base span covers, without signs at their ends, as spans."""
    def cover(acc, b):
        free = F.struct(acc["pos"].alias("start"), F.least(b["start"], c["end"]).alias("end"))
        inside = (b["start"] < c["end"]) & (c["start"] < b["end"])
        return F.when(inside, F.struct(
            F.greatest(acc["pos"], F.least(b["end"], c["end"])).alias("pos"),
            F.when(free["end"] > free["start"], F.concat(acc["out"], F.array(free))).otherwise(acc["out"]).alias("out"))).otherwise(acc)

    empty = F.struct(c["start"].alias("pos"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))
    free = F.aggregate(base, empty, cover, lambda acc: F.when(acc["pos"] < c["end"], F.concat(
        acc["out"], F.array(F.struct(acc["pos"].alias("start"), c["end"].alias("end"))))).otherwise(acc["out"]))

    def trimmed(p: Column) -> Column:
        s = F.substring(c["s"], p["start"] - c["start"] + 1, p["end"] - p["start"])
        lead = F.char_length(s) - F.char_length(F.regexp_replace(s, "^[^A-Za-z0-9+(\\[]++", ""))
        core = F.regexp_extract(s, "^[^A-Za-z0-9+(\\[]*+(.*[A-Za-z0-9)\\]])", 1)
        start = p["start"] + lead
        return F.struct(c["kind"].alias("kind"), start.alias("start"), (start + F.char_length(core)).alias("end"), core.alias("s"))

    whole = F.array(F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["s"].alias("s")))
    return F.when(c["known"], F.filter(F.transform(free, trimmed), lambda x: x["s"].rlike("[A-Za-z0-9]"))).otherwise(whole).cast(_SPAN)


def _added(judge: Judge, base: Column, found: Column) -> Column:
    """``base`` and what accepted candidates add to it: of overlapping ones the best, without what ``base`` covers."""
    ranked = F.array_sort(F.transform(F.filter(found, judge.accepts), lambda c: F.struct(
        (~c["fits"]).alias("a"), c["known"].alias("b"), (-judge.form(c)).alias("c"), (-judge.margin(c)).alias("d"),
        (c["start"] - c["end"]).alias("e"), c["start"].alias("f"), c.alias("of"))))

    def take(acc, x):
        return F.when(_overlaps(acc["taken"], x["of"]), acc).otherwise(F.struct(
            F.concat(acc["taken"], F.array(F.struct(x["of"]["start"].alias("start"), x["of"]["end"].alias("end")))).alias("taken"),
            F.concat(acc["out"], _rest(base, x["of"])).alias("out")))

    empty = F.struct(F.array().cast("array<struct<start:int,end:int>>").alias("taken"), _none().alias("out"))
    more = F.aggregate(ranked, empty, take, lambda acc: acc["out"])
    return F.when(F.exists(found, judge.accepts), _in_order(F.concat(base, more))).otherwise(base)


def _digest_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"),
                                                                 x["end"].cast("string"))), ",")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, spans) for every row: base spans and all spans, as arrays of (kind, start, end, s)."""
    found = cut(_located(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("__raw")),
                         F.col("__raw")).select("doc_id", F.col("__base").alias("base"),
                                                F.col("__candidates").alias("candidates"), _held(F.col("__raw")).alias("held")), "pii")
    judge = fit(found)
    return found.select("doc_id", "base", _added(judge, F.col("base"), F.col("candidates")).alias("spans"))


def digests(found: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, and all spans as text, of ``find``'s result."""
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS],
                        F.sha2(_digest_text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        _digest_text(F.col("spans")).alias("spans"))


def _redacted(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by its kind in brackets; overlapping spans are replaced together."""
    def add(acc, x):
        gap = F.substring(text, acc["pos"] + 1, F.greatest(x["start"] - acc["pos"], F.lit(0)))
        mark = F.concat(gap, F.lit("["), F.upper(x["kind"]), F.lit("]"))
        parts = F.when(x["start"] >= acc["pos"], F.concat(acc["parts"], F.array(mark))).otherwise(acc["parts"])
        return F.struct(F.greatest(acc["pos"], x["end"]).alias("pos"), parts.alias("parts"))

    empty = F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("parts"))
    whole = F.aggregate(spans, empty, add, lambda a: F.concat(
        F.array_join(a["parts"], ""), F.substring(text, a["pos"] + 1, F.greatest(F.char_length(text), F.lit(1)))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with all spans redacted in ``text_col``, columns unchanged; ``length_col`` follows where it exists."""
    columns = docs.columns
    judge = fit(cut(_located(docs.select(F.col(text_col).alias("__raw")), F.col("__raw"))
                    .where(F.size("__candidates") > 0).select(F.col("__candidates").alias("candidates"),
                                                             _held(F.col("__raw")).alias("held")), "pii"))
    out = _located(docs, F.col(text_col))
    out = out.withColumn("__spans", _added(judge, F.col("__base"), F.col("__candidates")))
    out = out.withColumn(text_col, _redacted(F.col(text_col), F.col("__spans")))
    if length_col in columns:
        out = out.withColumn(length_col, F.when(F.size("__spans") > 0, F.char_length(F.col(text_col)).cast("long"))
                             .otherwise(F.col(length_col)))
    return out.select(*columns)
