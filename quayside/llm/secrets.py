"""Secret scans with a random forest against false positives (operator 8), in
DataFrame functions and JVM machine learning only.

Patterns propose candidates from whole texts. A forest of decision trees,
trained on labelled findings, judges length, character transitions (the mean
log odds of a candidate's neighbouring characters among true and among false
findings), dictionary coverage, path-like surroundings and the words on both
sides, and drops the false ones. The labelled findings are given (at most
SAMPLE of them, least hash first) or made by rule from a seed.
"""

from __future__ import annotations

import json
import math
import random
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

#: Findings made for training.
FINDINGS = 8_000
#: Given findings that are learned from; a forest needs no more.
SAMPLE = 50_000
KEEP = 0.5
# fixed patterns: group 1 is the candidate
PATTERNS = {
    "cloud_key": r"(?<![A-Z0-9])((?:AKIA|ASIA)[0-9A-Z]{16})(?![A-Z0-9])",
    "code_host": r"(?<![A-Za-z0-9])(gh[pousr]_[A-Za-z0-9]{36})(?![A-Za-z0-9])",
    "chat_token": r"(?<![A-Za-z0-9])(xox[abprs]-[A-Za-z0-9-]{10,})",
    "pay_key": r"(?<![A-Za-z0-9])((?:sk|rk|pk)_(?:live|test)_[A-Za-z0-9]{16,})",
    "map_key": r"(?<![A-Za-z0-9])(AIza[A-Za-z0-9_-]{35})",
    "web_token": r"(?<![A-Za-z0-9])(eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*)",
    "assigned": r"(?i)(?:api[_-]?key|access[_-]?key|private[_-]?key|secret|token|passwd|password|auth|credential)s?[\"']?\x20{0,3}[:=]\x20{0,3}[\"']?([A-Za-z0-9+/_.=-]{8,})",
    "random": r"(?<![A-Za-z0-9+/_=.-])((?=[a-z+/_=.-]*+[0-9A-Z])(?=[A-Za-z+/_=.-]*+[0-9])(?=[0-9+/_=.-]*+[A-Za-z])[A-Za-z0-9+/_=-]{24,})(?![A-Za-z0-9+/_=-])",
}
#: A text is searched for a pattern only if this is found in it.
GATES = {
    "cloud_key": "contains(t, 'AKIA') or contains(t, 'ASIA')",
    "code_host": "t rlike 'gh[pousr]_'",
    "chat_token": "contains(t, 'xox')",
    "pay_key": "contains(t, '_live_') or contains(t, '_test_')",
    "map_key": "contains(t, 'AIza')",
    "web_token": "contains(t, 'eyJ')",
    "assigned": "t rlike '(?i)(?:key|secret|token|passwd|password|auth|credential)s?[\"\\']? {0,3}[:=]'",
    "random": "t rlike '[A-Za-z0-9+/_=-]{24}'",
}
# fixed word lists
WORDS = "the and for that with this from have not you are was key secret token password passwd auth access private public user name value data test example sample demo dummy change your here some other file path config default local host admin login service client server session string number index content module source target version build release image video static assets script style node main input output report update delete create select insert table column archive array backup base block branch button cache call check class cloud code color commit common component context control core count customer database date debug detail device document domain download email engine entry error event export feature field filter folder format frame function global group handle header helper history home icon import item label language layout library line link list load lock logger manager map media member memory menu message method model network object online option order package page panel parent partner payment platform plugin policy port post price process product profile project property query queue record region register request resource response result return role root route schema scope search section security settings shared size socket stage start state status storage store stream support switch".split()
CUES = "secret|token|api|key|passw|auth|credential|login|bearer"
#: Characters of the transition model: letters without case, 9 for digits, - for all others.
ALPHABET = "abcdefghijklmnopqrstuvwxyz9-"
AGAINST = "example|sample|test|dummy|placeholder|commit|sha1|sha256|md5|checksum|hash|revision|uuid|guid|build|version"
FEATURES = ("size", "distinct", "entropy", "digits", "uppers", "transitions", "odds", "vowels", "covered", "slashes", "dots", "run", "cue", "against", "path_before", "assigned", "hex_only", "against_after", "path_after", "closed")


def _pairs() -> str:
    """SQL for the cells of a candidate's neighbouring characters, row * size + column."""
    plain = "regexp_replace(regexp_replace(lower(secret), '[0-9]', '9'), '[^a-z9]', '-')"
    places = f"transform(filter(split({plain}, ''), c -> c <> ''), c -> instr('{ALPHABET}', c) - 1)"
    return f"flatten(transform(array({places}), p -> zip_with(slice(p, 1, greatest(size(p) - 1, 0)), slice(p, 2, size(p)), (x, y) -> x * {len(ALPHABET)} + y)))"


def transition_odds(findings: DataFrame) -> list[float]:
    """Per pair of neighbouring characters, the log odds of true against false
    findings, add-one smoothed. One partial sum per pair reaches the driver."""
    cells = len(ALPHABET) ** 2
    counts = findings.select(F.explode(F.expr(_pairs())).alias("pair"), "label").groupBy("pair").agg(F.sum("label").alias("yes"), F.sum(1 - F.col("label")).alias("no"))
    yes, no = [1.0] * cells, [1.0] * cells
    for row in counts.collect():  # at most len(ALPHABET) ** 2 rows
        yes[row["pair"]] += row["yes"]
        no[row["pair"]] += row["no"]
    return [math.log(y / sum(yes)) - math.log(n / sum(no)) for y, n in zip(yes, no)]


def features(found: DataFrame, odds: list[float]) -> DataFrame:
    """The forest's inputs from (secret, before, after)."""
    s, low = F.col("secret"), F.lower("secret")
    n = F.greatest(F.length(s), F.lit(1)).cast("double")
    share = lambda pattern, c=s: (F.length(c) - F.length(F.regexp_replace(c, pattern, ""))) / n
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "9")
    runs = F.length(F.regexp_replace(shape, r"(.)\1*", "$1"))
    chars = F.expr("filter(split(secret, ''), c -> c <> '')")
    found = found.withColumns({"chars": chars, "before": F.lower("before"), "after": F.lower("after")})
    table = "array(" + ", ".join(f"{x!r}D" for x in odds) + ")"
    mean_odds = F.expr(f"aggregate(transform(array({_pairs()}), p -> aggregate(p, 0D, (a, x) -> a + element_at({table}, x + 1)) / greatest(size(p), 1)), 0D, (a, x) -> a + x)")
    entropy = F.expr("-aggregate(transform(array_distinct(chars), c -> size(filter(chars, d -> d = c)) / double(size(chars))), 0D, (a, p) -> a + p * log2(p))")
    return found.withColumns(
        {
            "size": n,
            "distinct": F.size(F.array_distinct("chars")) / n,
            "entropy": F.when(F.size("chars") > 0, entropy).otherwise(0.0),
            "digits": share("[0-9]"),
            "uppers": share("[A-Z]"),
            "transitions": (runs - 1) / n,
            "odds": mean_odds,
            "vowels": share("[aeiouAEIOU]"),
            "covered": (F.length(low) - F.length(F.regexp_replace(low, "|".join(sorted(set(WORDS), key=lambda w: (-len(w), w))), ""))) / n,
            "slashes": share("/"),
            "dots": share(r"[.]"),
            "run": F.coalesce(F.array_max(F.expr(r"transform(regexp_extract_all(secret, '((.)\\2*)', 1), x -> length(x))")), F.lit(0)).cast("double"),
            "cue": F.col("before").rlike(CUES).cast("double"),
            "against": F.col("before").rlike(AGAINST).cast("double") + low.rlike("example|sample|dummy|change|your").cast("double"),
            "path_before": F.col("before").rlike("(?:/|\\\\|https?:|www)[^ ]*$").cast("double"),
            "assigned": F.col("before").rlike(r"[:=] {0,3}[\"']?$").cast("double"),
            "hex_only": s.rlike("^[0-9a-fA-F]+$").cast("double"),
            "against_after": F.col("after").rlike(AGAINST).cast("double"),
            "path_after": F.col("after").rlike("^[.][a-z]{2,4}\\b|^[/\\\\?(]").cast("double"),
            "closed": F.col("after").rlike("^[\"']").cast("double"),
        }
    )


def labelled_findings(spark: SparkSession, count: int = FINDINGS, seed: int = 17) -> DataFrame:
    """(secret, before, after, label), made by rule: random keys in assigning
    or cued surroundings and keys with a provider's prefix are secrets; words,
    placeholders, references, paths, runs, and hashes, numbers or embedded data
    in other surroundings are not."""
    r = random.Random(seed)
    lower, upper, digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    alnum, hexa = lower + upper + digit, digit + "abcdef"
    draw = lambda alphabet, n: "".join(r.choice(alphabet) for _ in range(n))
    one_of = lambda makers: r.choice(makers)()
    hashed = lambda: draw(hexa, r.choice([32, 40, 64]))
    names = ["token", "api_key", "apiKey", "secret", "password", "passwd", "auth_token", "access_key", "client_secret", "SECRET_KEY", "credentials"]
    plain = ["the value of", "see page", "in chapter", "and then", "as found in", "total"]
    negative = ["commit", "sha256 checksum", "md5", "uuid", "revision", "example", "build hash", "version"]
    syllables = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()
    spoken = lambda n: "".join(r.choice(syllables) for _ in range(n))
    prose = lambda: " ".join(r.choice([spoken(r.randint(1, 3)), r.choice(WORDS)]) for _ in range(r.randint(1, 4)))
    uuid = lambda: "-".join(draw(hexa, n) for n in (8, 4, 4, 4, 12))
    named = lambda: r.choice(names)

    def secret() -> str:
        return one_of([hashed, lambda: draw(alnum, r.randint(20, 48)), lambda: draw(alnum + "+/", r.randint(24, 64)), lambda: draw(digit + "ABCDEF", 40), lambda: draw(alnum, r.randint(7, 14)) + draw(digit, 2)])

    def prefixed() -> str:
        return one_of([lambda: "AKIA" + draw(upper + digit, 16), lambda: "ghp_" + draw(alnum, 36), lambda: "sk_live_" + draw(alnum, 24), lambda: "xoxb-" + draw(digit, 11) + "-" + draw(alnum, 24), lambda: "AIza" + draw(alnum + "_-", 35), lambda: "eyJ" + draw(alnum, 30) + "." + draw(alnum, 60) + "." + draw(alnum + "_-", 40)])

    def true() -> tuple[str, str, str]:
        quote = r.choice(["", '"', "'"])
        held = [
            lambda: (secret(), f"{prose()} {named()}{r.choice([' = ', '=', ': ', ':'])}{quote}", quote + r.choice(["", " ", "\n", ",", ";"]) + prose()),
            lambda: (secret(), f'{{"{named()}": "', '"' + r.choice([",", "}", "\n"]) + prose()),
            lambda: (secret(), f"export {named().upper()}={quote}", quote + "\n" + prose()),
            lambda: (draw(alnum, r.randint(24, 48)), f"{prose()} authorization: bearer ", r.choice(["\n", " ", '"']) + prose()),
            lambda: (prefixed(), f"{prose()} ", " " + prose()),
            lambda: (prefixed(), f"{named()}={quote}", quote + " " + prose()),
        ]
        return one_of(held)

    def false() -> tuple[str, str, str]:
        made = [
            lambda: ("_".join(r.sample(WORDS, 4)), f"{named()} = ", "\n" + prose()),
            lambda: ("your_" + named() + "_here", f'{named()} = "', '"'),
            lambda: (r.choice(["changeme", "placeholder", "password", "example", "dummy_key_"]) + draw(digit, r.randint(0, 3)), f"{named()}: ", " " + prose()),
            lambda: (".".join(r.sample(WORDS, r.randint(2, 3))), f"{named()} = ", r.choice(["(", "[", "()", "\n"]) + prose()),
            lambda: (spoken(r.randint(4, 7)), f"{prose()} {named()}: ", " " + prose()),
            lambda: (draw(r.choice(digit + lower + "x*"), 1) * r.randint(8, 40), f"{named()} = ", " " + prose()),
            lambda: ("/".join(r.sample(WORDS, 5)) + "/v" + draw(digit, 2), f"{r.choice(plain)} http://", r.choice([" ", "/", ".html", "?"]) + prose()),
            lambda: (hashed(), f"https://{spoken(3)}.com/{r.choice(WORDS)}/", r.choice([".png", ".js", ".css", "/", "?", " "]) + prose()),
            lambda: (uuid(), f"{r.choice(negative + plain)} ", " " + prose()),
            lambda: (hashed(), f"{prose()} {r.choice(negative)}{r.choice([' ', ': ', '=', ':'])}", " " + prose()),
            lambda: (hashed(), f"{prose()} ", r.choice(["  " + r.choice(WORDS) + ".tar.gz", " checksum", " (commit)", " sha256"])),
            lambda: (draw(alnum + "+/", r.randint(40, 200)) + "==", r.choice(["data:image/png;base64,", "integrity=\"sha512-", "sha384-"]), '"' + r.choice([">", " "])),
            lambda: ("".join(w.title() for w in r.sample(WORDS, 5)) + draw(digit, 1), f"{prose()} ", " " + prose()),
            lambda: ("-".join(r.sample(WORDS, 5)) + "-" + draw(digit, r.randint(1, 4)), f"{prose()} ", " " + prose()),
            lambda: (draw(digit, r.randint(24, 30)) + "x", f"{r.choice(plain)} ", " " + prose()),
            lambda: (spoken(r.randint(8, 16)) + draw(digit, 1), f"{r.choice(plain + names)} ", " " + prose()),
        ]
        return one_of(made)

    rows = [(*((true if i % 2 else false)()), float(i % 2)) for i in range(count)]
    rows = [(secret, before[-40:], after[:20], label) for secret, before, after, label in rows]
    told = F.lit(json.dumps([dict(zip(("secret", "before", "after", "label"), row)) for row in rows]))
    return spark.range(1).select(F.explode(F.from_json(told, "array<struct<secret:string,before:string,after:string,label:double>>")).alias("r")).select("r.*")


@dataclass(frozen=True)
class Forest:
    """The trees and the transition odds that one of their inputs is made of."""

    odds: list[float]
    trees: RandomForestClassificationModel

    def score(self, found: DataFrame) -> DataFrame:
        """found with `score`, the share of the forest that calls it a secret."""
        scored = self.trees.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(features(found, self.odds)))
        return scored.withColumn("score", F.round(vector_to_array("probability")[1], 6))


def train(findings: DataFrame, trees: int = 32, depth: int = 9, seed: int = 7, sample: int = SAMPLE) -> Forest:
    """From (secret, before, after, label); nulls count as empty, findings
    without a label are left out. At most `sample` findings, least hash first,
    reach the fit; they are one ordered partition, so that bagging draws the
    same rows in every run."""
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("secret", "before", "after")]
    told = findings.where("label IS NOT NULL").select(*texts, F.col("label").cast("double").alias("label"))
    told = materialize(told.orderBy(F.xxhash64("secret", "before", "after", "label"), "secret", "before", "after", "label").limit(sample), "findings")
    odds = transition_odds(told)
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(features(told, odds)).orderBy("secret", "before", "after").coalesce(1).select("x", "label")
    return Forest(odds, RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed).fit(rows))


def _candidates(kind: str) -> str:
    """SQL for array<struct<kind, s, e, secret, before, after>> of text t."""
    pattern = PATTERNS[kind].replace("\\", "\\\\").replace("'", "\\'")
    whole = f"regexp_extract_all(t, '{pattern}', 0)"
    inner = f"regexp_extract_all(t, '{pattern}', 1)"
    typed = "array<struct<kind:string,s:int,e:int,secret:string,before:string,after:string>>"
    spans = f"""aggregate(
        filter(zip_with(zip_with(p.gaps, zip_with(p.whole, p.inner, (w, i) -> struct(w, i)), (g, x) -> struct(g, x.w AS w, x.i AS i)), slice(p.gaps, 2, size(p.gaps)), (y, n) -> struct(y.g AS g, y.w AS w, y.i AS i, n)), y -> y.w IS NOT NULL),
        named_struct('a', cast(array() AS {typed}), 'at', 0),
        (acc, y) -> named_struct(
            'a', concat(acc.a, array(named_struct('kind', '{kind}', 's', acc.at + length(y.g) + length(y.w) - length(y.i), 'e', acc.at + length(y.g) + length(y.w), 'secret', y.i,
                'before', right(concat(right(y.g, 40), left(y.w, length(y.w) - length(y.i))), 40), 'after', left(y.n, 20)))),
            'at', acc.at + length(y.g) + length(y.w)),
        acc -> acc.a)"""
    return f"if({GATES[kind]}, flatten(transform(array(struct(split(t, '{pattern}', -1) AS gaps, {whole} AS whole, {inner} AS inner)), p -> {spans})), cast(array() AS {typed}))"


def scan_secrets(docs: DataFrame, findings: DataFrame | None = None, keep: float = KEEP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kind, start, end, secret_sha256, score) per finding kept; code
    points, end exclusive. Of patterns that find the same place the first
    listed names it.

    A null text counts as empty. Repeated rows give repeated findings, a null
    id stays null. A text without candidates gives no row, nor does an empty
    table; other columns are ignored. Positions are running lengths of matches
    and the pieces between them, one row at a time: nothing is gathered.
    """
    model = train(labelled_findings(docs.sparkSession) if findings is None else findings)
    text = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    found = "concat(" + ", ".join(map(_candidates, PATTERNS)) + ")"
    first = "filter(c, (x, i) -> NOT exists(slice(c, 1, i), y -> y.s < x.e AND x.s < y.e))"
    rows = text.select("doc_id", F.expr(found).alias("c")).where("size(c) > 0").select("doc_id", F.explode(F.expr(first)).alias("f"))
    held = materialize(rows.select("doc_id", "f.*"), "candidates")
    return model.score(held).where(F.col("score") >= keep).select("doc_id", "kind", F.col("s").cast("long").alias("start"), F.col("e").cast("long").alias("end"), F.sha2("secret", 256).alias("secret_sha256"), "score")
