"""Personal data by weak supervision, in DataFrame functions only.

Candidates come from one base pattern per kind and, for e-mail and phone, a looser one. Labelers
vote on every candidate: the base rule (pattern and checks), a gazetteer (top-level domains,
calling codes, issuer prefixes, address ranges), words in the context before it (WINDOW code points,
back to the end of the match before the last), and its edges.
Votes are yes, no or none. Expectation-maximisation over the counts of vote patterns (at most
4 kinds x 3**4 rows, whatever the input) estimates how reliable each labeler is; a naive-Bayes
span classifier is then trained on the resulting probabilities, over features of the span. A
span is reported if the base rule holds, or if the classifier gives ``threshold`` and it does not
overlap a reported base span.

One scan makes one row per document with its candidates; only pattern counts and feature counts
are aggregated, partly summed before the shuffle. The driver holds fixed-size parameter tables.

Defined results. Null or empty text: no spans. Offsets are code points, end exclusive. Every row
gives one row, repeated ones too. Base patterns are matched leftmost without overlap per kind;
their possessive forms and the ``\\G`` anchor change speed on long runs, not matches.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapelab.session import stage

KINDS = ("email", "ip", "card", "phone")
# fixed values: the four base patterns
_LOCAL = "A-Za-z0-9._%+-"
BASE = (
    rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
LOOSE = {
    0: rf"(?<![{_LOCAL}])[{_LOCAL}]++\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]++(?:(?:\x20?[\[(](?:dot|DOT)[\])]\x20?|\.)[A-Za-z0-9-]++)++",
    3: r"(?<![0-9+.-])\(?[2-9][0-9]{2}\)?[\x20.-]\x20?[0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])",
}
# gazetteers
DOMAINS = ("com", "org", "net", "edu", "gov", "info", "io", "example", "test", "de", "fr", "es", "uk", "eu", "it", "nl", "ch", "at", "us", "co")
CALLING_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "39", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54", "55", "61",
                 "81", "86", "91")
CONTEXT = (
    r"e-?mail|mail|contact|correo|courriel|kontakt|write to",
    r"\bip\b|address|host|server|adresse|direcci",
    r"card|visa|master|credit|karte|carte|tarjeta|iban|account",
    r"phone|tel|call|mobile|fax|telefon|tel[eé]fono|t[eé]l[eé]phone|ruf",
)
WINDOW = 40
VOTES = ("rule", "gazetteer", "context", "edges")
ROUNDS = 15
PRIOR = 1.0  # added to every count
THRESHOLD = 0.95


def _spans(t: Column, pattern: str, kind: int, loose: bool, guard: Column) -> Column:
    """Matches with their offsets and what stands around them: the pieces between come from a split by the same pattern.

    Offsets are running sums over blocks of about the square root of the number of matches, so that appending copies
    little, and what stands around a match is taken from the pieces next to it, never sought from the text's start.
    """
    found = F.array(F.struct(F.split(t, pattern, -1).alias("gaps"), F.regexp_extract_all(t, F.lit(pattern), F.lit(0)).alias("hits")))
    tail = lambda x, n: F.right(F.coalesce(x, F.lit("")), F.lit(n))
    none = F.array().cast("array<struct<kind:int,start:int,end:int,hit:string,loose:boolean,before:string,left:string,right:string>>")

    def pieces(s):
        def piece(hit, i):
            gap, last, earlier = F.get(s["gaps"], i), F.get(s["hits"], i - 1), F.get(s["gaps"], i - 1)
            after = F.concat(F.left(F.get(s["gaps"], i + 1), F.lit(1)), F.left(F.coalesce(F.get(s["hits"], i + 1), F.lit("")), F.lit(1)))
            before = tail(F.concat(tail(earlier, WINDOW), tail(last, WINDOW), tail(gap, WINDOW)), WINDOW)
            return F.struct(F.length(gap).alias("skip"), F.length(hit).alias("size"), hit.alias("hit"), before.alias("before"), F.left(after, F.lit(1)).alias("right"))

        return F.struct(F.transform(s["hits"], piece).alias("p"), F.ceil(F.sqrt(F.size(s["hits"]))).cast("int").alias("width"))

    def blocks(s):
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(s["p"]) - 1) / s["width"]).cast("int")),
                          lambda i: F.slice(s["p"], i * s["width"] + 1, s["width"]))
        return F.transform(cut, lambda block: F.struct(block.alias("p"), F.aggregate(block, F.lit(0), lambda n, x: n + x["skip"] + x["size"]).alias("n")))

    def placed(block, at):
        def step(acc, x):
            a = acc["at"] + x["skip"]
            new = F.struct(F.lit(kind).alias("kind"), a.alias("start"), (a + x["size"]).alias("end"), x["hit"].alias("hit"), F.lit(loose).alias("loose"),
                           x["before"].alias("before"), F.right(x["before"], F.lit(1)).alias("left"), x["right"].alias("right"))
            return F.struct((a + x["size"]).alias("at"), F.concat(acc["out"], F.array(new)).alias("out"))

        return F.aggregate(block, F.struct(at.alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    def one(s):
        def step(acc, x):
            return F.struct((acc["at"] + x["n"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

        starts = F.aggregate(s["b"], F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), step, lambda acc: acc["out"])
        return F.flatten(F.zip_with(s["b"], starts, lambda x, at: placed(x["p"], at)))

    some = F.transform(F.filter(F.transform(found, pieces), lambda s: s["width"] > 0), lambda s: F.struct(blocks(s).alias("b")))
    return F.when(guard, F.flatten(F.transform(some, one))).otherwise(none)


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def step(acc, i):
        d = F.substr(digits, n - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step) % 10 == 0


def _small_part(part: Column) -> Column:
    p = F.regexp_replace(part, "^0+(?=.)", "")
    return F.when(F.length(p) <= 3, p.cast("int") <= 255).otherwise(False)


def _rule(c: Column) -> Column:
    """Whether a match of a base pattern passes the checks of its kind."""
    digits = _digits(c["hit"])
    n = F.length(digits)
    return (F.when(c["kind"] == 0, True).when(c["kind"] == 1, F.forall(F.split(c["hit"], r"\."), _small_part))
            .when(c["kind"] == 2, F.when(n.between(14, 19), _luhn(digits)).otherwise(False)).otherwise(n.between(10, 15)))


def _gazetteer(c: Column) -> Column:
    digits = _digits(c["hit"])
    domain = F.lower(F.regexp_extract(c["hit"], r"([A-Za-z0-9-]+)$", 1))
    code = F.exists(F.array(*map(F.lit, CALLING_CODES)), lambda x: F.startswith(digits, x))
    return (F.when(c["kind"] == 0, domain.isin(*DOMAINS)).when(c["kind"] == 1, ~F.substr(c["hit"], F.lit(1), F.lit(2)).isin("0.", "00"))
            .when(c["kind"] == 2, F.substr(digits, F.lit(1), F.lit(1)).isin("3", "4", "5", "6")).otherwise(code))


def candidates(t: Column) -> Column:
    """All candidates of a text, with votes (1 yes, 0 no, -1 none) and feature values."""
    has = lambda s: F.instr(t, s) > 0
    number = F.rlike(t, F.lit(r"[0-9][\x20-]?[0-9]"))  # as the card pattern, which lets a blank or hyphen stand between any two digits
    ip = F.rlike(t, F.lit(r"[0-9]\.[0-9]"))
    guards = (has("@"), ip, number, has("+"))
    found = [_spans(t, p, k, False, guards[k]) for k, p in enumerate(BASE)]
    found += [_spans(t, LOOSE[0], 0, True, has("(at") | has("[at") | has("(AT") | has("[AT")), _spans(t, LOOSE[3], 3, True, F.rlike(t, F.lit("[0-9]{4}")))]

    def vote(c: Column) -> Column:
        before, left, right = F.lower(c["before"]), c["left"], c["right"]
        near = F.element_at(F.array(*[F.rlike(before, F.lit(p)) for p in CONTEXT]), c["kind"] + 1)
        edges = ~(F.rlike(left, F.lit(r"[\p{L}\p{N}_]"))) & ~F.rlike(right, F.lit(r"[\p{L}\p{N}_@]"))
        rule = F.when(c["loose"], F.lit(-1)).when(_rule(c), 1).otherwise(0)
        size = c["end"] - c["start"]
        share = F.length(_digits(c["hit"])) * 4 / size
        return F.struct(
            c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), rule.alias("rule"),
            F.when(_gazetteer(c), 1).otherwise(0).alias("gazetteer"), F.when(near, 1).otherwise(-1).alias("context"),
            F.when(edges, 1).otherwise(0).alias("edges"), F.least(F.floor(size / 4), F.lit(10)).cast("int").alias("length"),
            F.floor(share).cast("int").alias("digits"))

    return F.transform(F.concat(*found), vote)


def estimate(patterns: DataFrame) -> tuple[dict, dict]:
    """Log-odds of each kind and of each (labeler, vote), by expectation-maximisation over counted vote patterns.

    ``patterns``: kind, the votes, n. Starts from the share of yes among a candidate's votes.
    """
    rows = patterns.select("kind", *VOTES, "n").collect()  # at most 4 x 81
    yes = [(sum(r[v] == 1 for v in VOTES) + 0.5) / (sum(r[v] >= 0 for v in VOTES) + 1.0) for r in rows]
    kinds, votes = {}, {}
    for _ in range(ROUNDS):
        n = Counter()
        for r, p in zip(rows, yes):
            for side, w in enumerate((r["n"] * p, r["n"] * (1 - p))):
                n[r["kind"], side] += w
                for v in VOTES:
                    n[v, r[v], side] += w
        kinds = {k: math.log((n[k, 0] + PRIOR) / (n[k, 1] + PRIOR)) for k in range(len(KINDS))}
        for v in VOTES:
            totals = [sum(n[v, s, side] + PRIOR for s in (-1, 0, 1)) for side in (0, 1)]
            votes |= {(v, s): math.log((n[v, s, 0] + PRIOR) / totals[0] / ((n[v, s, 1] + PRIOR) / totals[1])) for s in (-1, 0, 1)}
        yes = [1 / (1 + math.exp(-kinds[r["kind"]] - sum(votes[v, r[v]] for v in VOTES))) for r in rows]
    return kinds, votes


def posterior(kinds: dict, votes: dict) -> Column:
    odds = F.element_at(F.array(*[F.lit(kinds[k]) for k in range(len(KINDS))]), F.col("kind") + 1)
    for v in VOTES:
        odds = odds + F.element_at(F.array(*[F.lit(votes[(v, s)]) for s in (-1, 0, 1)]), F.col(v) + 2)
    return 1 / (1 + F.exp(-odds))


FEATURES = ("rule", "gazetteer", "context", "edges", "length", "digits")


def train(counted: DataFrame) -> dict:
    """Log-odds of the span classifier by (kind, feature, value), from candidates counted with their probability ``p``."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in FEATURES])).alias("x")
    sums = (counted.select("kind", "n", "p", pairs).groupBy("kind", "x.feature", "x.value")
            .agg(F.sum(F.col("n") * F.col("p")).alias("yes"), F.sum(F.col("n") * (1 - F.col("p"))).alias("no")).collect())
    model = {}
    for k in range(len(KINDS)):
        rows = [r for r in sums if r["kind"] == k]
        yes, no = (sum(r[c] for r in rows if r["feature"] == FEATURES[0]) + PRIOR for c in ("yes", "no"))
        model[k, "", 0] = math.log(yes / no)
        model |= {(k, r["feature"], r["value"]): math.log((r["yes"] + PRIOR) / (yes + PRIOR) / ((r["no"] + PRIOR) / (no + PRIOR))) for r in rows}
    return model


def _score(c: Column, model: dict) -> Column:
    """Probability of a candidate under the classifier; values never seen weigh 0."""
    table = F.create_map(*[x for (k, f, v), w in sorted(model.items()) for x in (F.lit(f"{k}{f}{v}"), F.lit(w))])
    get = lambda f, v: F.coalesce(F.try_element_at(table, F.concat(c["kind"].cast("string"), F.lit(f), v.cast("string"))), F.lit(0.0))
    odds = get("", F.lit(0))
    for f in FEATURES:
        odds = odds + get(f, c[f])
    return 1 / (1 + F.exp(-odds))


def find(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, base and spans of every row: arrays of (start, kind number, end), sorted."""
    rows = stage(docs.select(F.col(doc_id).alias("doc_id"), candidates(F.coalesce(F.col(text), F.lit(""))).alias("found")))
    each = rows.select(F.explode("found").alias("c")).select("c.*")
    counted = stage(each.groupBy("kind", *FEATURES).agg(F.count(F.lit(1)).alias("n")))
    kinds, votes = estimate(counted.groupBy("kind", *VOTES).agg(F.sum("n").alias("n")))
    model = train(counted.withColumn("p", posterior(kinds, votes)))
    span = lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"))
    base = F.filter("found", lambda c: c["rule"] == 1)
    more = F.filter("found", lambda c: (c["rule"] != 1) & (_score(c, model) >= threshold)
                    & ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    based = rows.withColumn("base", F.array_sort(F.transform(base, span)))
    return based.select("doc_id", "base", F.array_sort(F.concat("base", F.transform(more, span))).alias("spans"))


def _text(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    found = find(docs)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", *map(count, range(len(KINDS))), F.sha2(_text("base").cast("binary"), 256).alias("base_sha256"), _text("spans").alias("spans"))
