"""PII spans by weak supervision (operator 1), in DataFrame functions only.

Patterns propose spans. Five labelers vote on each proposal: the strict
pattern with its checks, a gazetteer, the words before it, its borders, and
its digits. Counts of (kind, vote pattern) go to the driver, at most
4 * 2 * 3^5 rows, where expectation-maximisation estimates each labeler's
reliability and a logistic span classifier is fitted to the posteriors.
Proposals that it accepts are added to the base spans, which always stay.
Texts are read once; proposals are written down and read twice.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

KINDS = ("email", "ip", "card", "phone")
#: An added span needs this probability.
ACCEPT = 0.9

# Possessive quantifiers keep matching linear and off Java's stack; \G lets a
# match start where the last one ended, inside a run.
_LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(]\x20?(?:at|AT)\x20?[\])]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(]\x20?(?:dot|DOT)\x20?[\])]\x20?)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9.])[0-9]{4}\.[0-9]{4}\.[0-9]{4}\.[0-9]{4}(?![0-9.])",
    "phone": r"(?<![0-9+()-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9-])",
}
#: A text is searched for a pattern only if this is found in it.
GATE = {
    ("email", "base"): "contains(t, '@')",
    ("email", "loose"): r"t rlike '[\\[(] ?(?:at|AT) ?[\\])]'",
    ("ip", "base"): r"t rlike '[0-9]\\.[0-9]'",
    ("ip", "loose"): "t rlike '[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:'",
    ("card", "base"): "t rlike '[0-9][ -]?[0-9]'",
    ("card", "loose"): r"t rlike '[0-9]{4}\\.[0-9]{4}\\.'",
    ("phone", "base"): r"t rlike '\\+[0-9]'",
    ("phone", "loose"): "t rlike '[0-9]{3}[.-][0-9]{4}'",
}
_DIGITS = "regexp_replace(x.m, '[^0-9]', '')"
_LUHN = f"aggregate(transform(split(reverse({_DIGITS}), ''), (c, i) -> (if(i % 2 = 1, int(c) * 2 - if(int(c) > 4, 9, 0), int(c)))), 0, (a, b) -> a + b) % 10 = 0"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
CHECK = {
    "email": "true",
    "ip": rf"x.m rlike '^{_OCTET}(?:\\.{_OCTET}){{3}}$'",
    "card": f"if(length({_DIGITS}) between 14 and 19, {_LUHN}, false)",
    "phone": f"length({_DIGITS}) between 10 and 15",
}
# fixed word lists of the gazetteer and context labelers
GAZETTEER = {
    "email": r"lower(x.m) rlike '(?:\\.|dot ?[\\])] ?)(?:com|org|net|edu|gov|info|io|de|fr|es|it|nl|uk|eu|ch|at)$'",
    "ip": r"x.m rlike '^0*(?:[1-9]|[1-9][0-9]|1[0-9][0-9]|2[01][0-9]|22[0-3])\\.' or x.m rlike '^[23][0-9A-Fa-f]{3}:'",
    "card": f"{_DIGITS} rlike '^(?:4|5[1-5]|2[2-7]|3[47]|35|6011|65)'",
    "phone": r"x.m rlike '^\\+(?:1|7|3[0-9]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])' or x.m rlike '^\\(?[2-9][0-9]{2}'",
}
CUES = {"email": "mail|contact|correo|courriel|kontakt", "ip": "ip|host|server|address|addr", "card": "card|visa|credit|karte|carte|tarjeta", "phone": "phone|tel|call|fax|mobile|m[oó]vil|telefon"}
AGAINST = "order|invoice|isbn|sku|version|serial|part no|article|ref"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _proposals(kind: str, which: str) -> str:
    """SQL for array<struct<k, s, e, strict, votes>> of text t. Matches and the
    pieces between them alternate, so positions are running lengths."""
    pattern = _quoted((BASE if which == "base" else LOOSE)[kind])
    spans = f"""aggregate(
        filter(zip_with(zip_with(p.gaps, p.found, (g, m) -> struct(g, m)), slice(p.gaps, 2, size(p.gaps)), (y, n) -> struct(y.g AS g, y.m AS m, n)), y -> y.m IS NOT NULL),
        named_struct('a', cast(array() AS array<struct<s:int,e:int,m:string,b:string,n:string>>), 'at', 0),
        (acc, y) -> named_struct(
            'a', concat(acc.a, array(named_struct('s', acc.at + length(y.g), 'e', acc.at + length(y.g) + length(y.m), 'm', y.m, 'b', right(y.g, 40), 'n', left(y.n, 1)))),
            'at', acc.at + length(y.g) + length(y.m)),
        acc -> acc.a)"""
    strict = CHECK[kind] if which == "base" else "false"
    votes = ", ".join(
        (
            f"if({strict}, '1', '0')" if which == "base" else "'-'",
            f"if({GAZETTEER[kind]}, '1', '0')",
            rf"CASE WHEN lower(x.b) rlike '\\b(?:{CUES[kind]})' THEN '1' WHEN lower(x.b) rlike '\\b(?:{AGAINST})' THEN '0' ELSE '-' END",
            r"if(right(x.b, 1) rlike '[\\p{L}0-9]' or x.n rlike '[\\p{L}0-9]', '0', '1')",
            r"if(x.m rlike '([0-9])\\1{5,}', '0', '-')",
        )
    )
    k = KINDS.index(kind)
    return f"""if({GATE[kind, which]},
        flatten(transform(array(struct(split(t, {pattern}, -1) AS gaps, regexp_extract_all(t, {pattern}, 0) AS found)), p ->
            transform({spans}, x -> named_struct('k', {k}, 's', x.s, 'e', x.e, 'strict', {strict}, 'votes', concat({votes}))))),
        cast(array() AS array<struct<k:int,s:int,e:int,strict:boolean,votes:string>>))"""


def estimate(counts: list[tuple[int, str, int]], rounds: int = 50) -> dict[tuple[int, str], float]:
    """Posterior of being personal data per (kind, votes), by expectation-
    maximisation over labelers that are independent given the truth.
    Pseudo-counts hold labelers to being right more often than not."""
    labelers = range(5)
    posterior = {(k, v): (1 + 3 * v.count("1")) / (2 + 3 * (v.count("1") + v.count("0"))) for k, v, _ in counts}
    for _ in range(rounds):
        prior, right = {}, {}
        for k in range(len(KINDS)):
            own = [(v, n) for kk, v, n in counts if kk == k]
            total = sum(n for _, n in own)
            yes = sum(n * posterior[k, v] for v, n in own)
            prior[k] = (yes + 1) / (total + 2)
            for i in labelers:
                for truth in (1, 0):
                    share = {v: n * (posterior[k, v] if truth else 1 - posterior[k, v]) for v, n in own}
                    voted = sum(s for v, s in share.items() if v[i] != "-")
                    agreed = sum(s for v, s in share.items() if v[i] == str(truth))
                    right[k, i, truth] = min(0.999, max(0.5, (agreed + 40) / (voted + 50)))
        for k, v, _ in counts:
            yes, no = math.log(prior[k]), math.log(1 - prior[k])
            for i in labelers:
                if v[i] != "-":
                    yes += math.log(right[k, i, 1] if v[i] == "1" else 1 - right[k, i, 1])
                    no += math.log(right[k, i, 0] if v[i] == "0" else 1 - right[k, i, 0])
            posterior[k, v] = 1 / (1 + math.exp(min(700, no - yes)))
    return posterior


def span_classifier(counts: list[tuple[int, str, int]], posterior: dict[tuple[int, str], float], rounds: int = 400, rate: float = 0.5) -> dict[tuple[int, str], float]:
    """Logistic regression of the posteriors on kind and votes; its probability
    per (kind, votes)."""
    def features(k: int, v: str) -> list[str]:
        return ["bias", f"kind{k}", *[f"{i}{c}" for i, c in enumerate(v) if c != "-"], *[f"{k}:{i}{c}" for i, c in enumerate(v) if c != "-"]]

    weight: dict[str, float] = {}
    total = sum(math.sqrt(n) for _, _, n in counts) or 1
    rows = [(features(k, v), posterior[k, v], math.sqrt(n) / total) for k, v, n in sorted(counts)]
    logit = lambda f: sum(weight.get(x, 0.0) for x in f)
    for _ in range(rounds):
        slope: dict[str, float] = {}
        for f, y, n in rows:
            miss = n * (y - 1 / (1 + math.exp(-max(-30, min(30, logit(f))))))
            for x in f:
                slope[x] = slope.get(x, 0.0) + miss
        for x, s in slope.items():
            weight[x] = weight.get(x, 0.0) * (1 - 1e-4) + rate * 4 * s
    return {(k, v): 1 / (1 + math.exp(-max(-30, min(30, logit(features(k, v)))))) for k, v, _ in counts}


def pii_spans(docs: DataFrame, accept: float = ACCEPT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added)
    per row of docs; counts and digest are of the base spans, spans lists all
    as kind:start:end.

    A null text counts as empty: no spans, the digest of the empty string.
    Added spans that touch a base span or an earlier added one are dropped.
    Repeated rows give equal rows, a null id stays null. An empty table gives
    no rows; other columns are ignored.
    """
    text = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    found = ", ".join(_proposals(k, w) for k in KINDS for w in ("base", "loose"))
    held = materialize(text.select("doc_id", F.expr(rf"if(t rlike '[0-9@]' or t rlike '(?:at|AT) ?[\\])]' or t rlike '[a-f]:[0-9a-f]{{1,4}}:', concat({found}), cast(array() AS array<struct<k:int,s:int,e:int,strict:boolean,votes:string>>))").alias("found")), "proposals")

    counted = [(r["k"], r["votes"], r["count"]) for r in held.select(F.explode("found").alias("x")).groupBy("x.k", "x.votes").count().collect()]
    sure = span_classifier(counted, estimate(counted))
    taken = sorted(f"{k}{v}" for (k, v), p in sure.items() if p >= accept)
    accepted = F.array(*[F.lit(x) for x in taken]).cast("array<string>")

    held = held.select("doc_id", F.expr("filter(found, x -> x.strict)").alias("base"), F.expr("filter(found, x -> NOT x.strict)").alias("open"), accepted.alias("accepted"))
    held = held.select("doc_id", "base", F.expr("filter(open, x -> array_contains(accepted, concat(x.k, x.votes)) AND NOT exists(base, y -> x.s < y.e AND y.s < x.e))").alias("open"))
    added = F.expr("""aggregate(array_sort(transform(open, x -> struct(x.s AS s, x.k AS k, x.e AS e))), cast(array() AS array<struct<s:int,k:int,e:int>>),
        (acc, x) -> if(size(acc) > 0 AND element_at(acc, -1).e > x.s, acc, concat(acc, array(x))))""")
    held = held.select("doc_id", F.expr("array_sort(transform(base, x -> struct(x.s AS s, x.k AS k, x.e AS e)))").alias("base"), added.alias("added"))
    kinds = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    written = "array_join(transform({}, x -> concat_ws(':', element_at(" + kinds + ", x.k + 1), x.s, x.e)), ',')"
    return held.select(
        "doc_id",
        *[F.expr(f"cast(size(filter(base, x -> x.k = {i})) AS long)").alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(F.expr(written.format("base")), 256).alias("base_sha256"),
        F.expr(written.format("array_sort(concat(base, added))")).alias("spans"),
        F.expr("cast(size(added) AS long)").alias("n_added"),
    )
