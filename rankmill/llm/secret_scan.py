"""Operator 4: secret scans. Candidates by pattern, false positives removed by a random forest.

DataFrame functions only: lines are split and matched, features are expressions, and the forest is compiled into one
expression. Its trees are grown with numpy on the driver from a bounded table of labelled findings, whose features come
from the same expressions. Nothing is shuffled.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: = only ends a value: before it stands a name. A private key is found by its first line.
TOKEN = "-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----|[A-Za-z0-9+/_-]{16,}={0,2}"
NAMED = "(?i)(?:pass(?:word|wd|phrase)?|secret|token|api_?-?key|pwd|credential)s?[\"']?\\s{0,4}[:=]\\s{0,4}[\"']?([^\\s\"',;<>]{8,})"
NEAR = 48
TREES, DEPTH, MAX_LABELLED, SEED = 15, 5, 20_000, 5

# Words that names and prose are made of.
DICTIONARY = (
    "the and for with this that from your have not use user name test data file path page index main class method function string "
    "number value object array list item type error config setting default example sample dummy placeholder change here insert service "
    "client server request response handler manager factory builder controller model view table column query update delete create "
    "license version release build project module package library public private static final return image html http https www com "
    "org net css script style content header footer button title description keyword token secret password account key access auth"
).split()

#: What issuers put before their keys.
ISSUED = "^(?:A[KS]IA[A-Z2-7]{12}|AIza|gh[oprsu]_|glpat-|[rs]k_live_|xox[abprs]-|npm_|pypi-|SG\\.|-----BEGIN )"

FEATURES = ("chars", "transitions", "digits", "distinct", "coverage", "slashes", "dashes", "hexadecimal", "vowels", "issued", "named", "benign", "quoted", "sample_path")
#: Those that depend on the place on the line.
OF_PLACE = ("named", "benign", "quoted")


def features(value: Column, left: Column, path: Column) -> dict[str, Column]:
    """Numbers that tell a secret from a lookalike: value, the text before it on its line, where it was found."""
    n = F.greatest(F.length(value), F.lit(1))
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[A-Z]", "A"), "[a-z]", "a"), "[0-9]", "0")
    runs = F.regexp_replace(F.regexp_replace(classes, "[^Aa0]", "-"), "(.)\\1+", "$1")
    left = F.lower(left)
    share = lambda pattern: 1 - F.length(F.regexp_replace(value, pattern, "")) / n
    return {
        "chars": n.cast("double"),
        "transitions": (F.length(runs) - 1) / n,
        "digits": share("[0-9]"),
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / n,
        "coverage": 1 - F.length(F.regexp_replace(F.lower(value), "(?:" + "|".join(sorted(set(DICTIONARY), key=lambda w: (-len(w), w))) + ")", "")) / n,
        "slashes": share("/"),
        "dashes": share("[-_]"),
        "hexadecimal": value.rlike("^[0-9a-fA-F-]+$").cast("double"),
        "vowels": share("[aeiouAEIOU]"),
        "issued": value.rlike(ISSUED).cast("double"),
        "named": left.rlike("(?:token|secret|passw|pwd|passphrase|api.?key|auth|credential|private)[^\\n]{0,12}$").cast("double"),
        "benign": left.rlike("(?:sha|hash|commit|checksum|uuid|guid|digest|md5|etag|revision|example|sample|dummy|session id|order)[^\\n]{0,16}$").cast("double"),
        "quoted": left.rlike("[\"'=:]\\s*$").cast("double"),
        "sample_path": F.coalesce(F.lower(path).rlike("test|example|sample|fixture|docs?/|mock"), F.lit(False)).cast("double"),
    }


def labelled_findings(seed: int = SEED, n: int = 1200) -> list[tuple[str, str, str, int]]:
    """(left, value, path, label): findings of known kinds, made by rule; 1: a secret."""
    r = random.Random(seed)
    hexes, base = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    run = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    names = ["token", "TOKEN", "api_key", "API_KEY", "secret", "client_secret", "password", "auth_token", "access token", "private_key"]
    benign = ["commit", "sha256", "checksum", "uuid", "digest", "md5", "etag", "revision", "order", "session id", "hash"]
    syllables = "ver er un ge ent lich keit ung haupt stand bund recht schaft arbeit zeit tion ment able inter over under counter lation ive ness de la ción ado mente eau ette".replace("ó", "o").split()
    word = lambda k: "".join(r.choice(syllables) for _ in range(k))
    codes = ["lib/app", "config", "deploy", "blog/post", "pages", "core/main.py", "web", "notes.txt"]
    plain = "horse battery staple purple monkey dragon summer winter hunter sunshine banana coffee tiger rocket guitar silver orange shadow pirate castle".split()
    out = []
    for i in range(n):
        name, path = r.choice(names), r.choice(codes)
        head = f"{name}{r.choice([' = ', ': ', '=', ' := '])}{r.choice(['\"', '\'', ''])}"
        kind = i % 16
        if kind < 3:
            out.append((head, run(hexes if r.random() < 0.7 else "0123456789ABCDEF", r.choice([32, 40, 48, 64])), path, 1))
        elif kind == 3:
            out.append((head, run(base, r.choice([20, 24, 32, 40, 64])), path, 1))
        elif kind == 4:
            out.append((r.choice(["", "key ", head]), r.choice(["AKIA" + run(base[:26] + "0123456789", 16), "ghp_" + run(base, 36), "sk_live_" + run(base, 24), "xoxb-" + run("0123456789", 11) + "-" + run(base, 24)]), path, 1))
        elif kind == 5:
            out.append((r.choice(benign) + r.choice([" ", ": ", "="]), run(hexes, r.choice([32, 40, 64])), path, 0))
        elif kind == 6:
            out.append((r.choice(["id ", "uuid: ", "ref=", ""]), "-".join(run(hexes, k) for k in (8, 4, 4, 4, 12)), path, 0))
        elif kind == 7:
            w = r.sample(DICTIONARY, r.randint(3, 5))
            out.append((r.choice(["call ", "see ", "", head]), r.choice(["_".join(w), "".join(x.title() for x in w), "-".join(w), "/".join(w)]) + str(r.randint(0, 99)), r.choice([path, "docs/x", "tests/a"]), 0))
        elif kind == 8:
            out.append((head, r.choice(["your_token_here_", "changeme-example-", "xxxxxxxxxxxxxxxx", "0000000000000000", "placeholder_value_"]) + str(r.randint(0, 9)), r.choice([path, "docs/readme"]), 0))
        elif kind == 14:  # passwords that are words
            pw = "".join(r.sample(plain, r.randint(2, 3))) + r.choice(["", "", str(r.randint(1, 9999)), "!", "#1"])
            head = r.choice(["password", "passwd", "pwd", "db_password", "passphrase", "PASSWORD"]) + r.choice([" = ", ": ", "=", " := "]) + r.choice(['"', "'", ""])
            out.append((head, r.choice([pw, pw.title(), run(base + "!@%", r.randint(8, 14))]), path, 1))
        elif kind == 15:  # what code and manuals assign to such names, and first lines of keys
            if r.random() < 0.2:
                out.append(("", f"-----BEGIN {r.choice(['RSA ', 'EC ', '', 'OPENSSH '])}PRIVATE KEY-----", path, 1))
            else:
                w = r.sample(DICTIONARY, r.randint(2, 3))
                out.append((head, r.choice([f"get{w[0].title()}{w[1].title()}()", f"{w[0]}.{w[1]}.value", f"${{{w[0].upper()}_{w[1].upper()}}}", f"os.environ[{w[0]}]", "********", "<your-" + w[0] + ">", "_".join(w)]), path, 0))
        elif kind == 10:  # keys that happen to have no digit
            key = r.choice(["AKIA" + run(base[:26], 16), "ASIA" + run(base[:26], 16), "ghp_" + run(base[:52], 36)])
            out.append((r.choice(["", "key ", "uses ", head]), key, path, 1))
        elif kind == 11:
            out.append((r.choice(["", "key ", "uses ", head, head]), run(base[:52] if r.random() < 0.7 else base, r.choice([16, 20, 24, 32])), path, 1))
        elif kind >= 12:  # long words
            w = word(9).ljust(32, "e")[: r.choice([16, 16, 17, 17, 18, 19, 20, 22, 26, 32])]
            w = r.choice([w, w, w.title(), w.title(), w.upper(), word(3).ljust(8, "n") + "".join(word(2).title() for _ in range(r.randint(1, 3))).ljust(8, "e")])
            out.append((r.choice(["", "", "the ", "call ", "key ", "uses "]), w, path, 0))
        else:
            out.append((r.choice(["call ", "tel ", "", "at "]), r.choice([run("0123456789", r.randint(16, 20)), "=" * 18 + "1", "abc123" * 4, run("ab", 3) + "/" + run("cde", 8) + "/" + run("fgh", 7) + "1"]), path, 0))
    return out


class Forest:
    """Trees on bootstrap rows, splitting by Gini impurity over a random half of the features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = SEED):
        self.rng = np.random.default_rng(seed)
        self.trees = []
        for _ in range(trees):
            rows = self.rng.integers(0, len(y), len(y)) if len(y) else np.empty(0, int)
            self.trees.append(self._grow(x[rows], y[rows], depth))

    def _grow(self, x, y, depth):
        leaf = float((y.sum() + 0.5) / (len(y) + 1))
        if not depth or len(y) < 8 or len(set(y.tolist())) < 2:
            return leaf
        best = None
        for f in sorted(self.rng.choice(x.shape[1], (x.shape[1] + 1) // 2, replace=False).tolist()):
            order = np.argsort(x[:, f], kind="stable")
            v, ones = x[order, f], np.cumsum(y[order])
            n = np.arange(1, len(y))
            a, b = ones[:-1] / n, (ones[-1] - ones[:-1]) / (len(y) - n)
            cost = np.where(v[1:] > v[:-1], n * a * (1 - a) + (len(y) - n) * b * (1 - b), np.inf)
            i = int(np.argmin(cost))
            if np.isfinite(cost[i]) and (best is None or cost[i] < best[0]):
                best = float(cost[i]), f, float((v[i] + v[i + 1]) / 2)
        if best is None:
            return leaf
        _, f, cut = best
        low = x[:, f] <= cut
        return f, cut, self._grow(x[low], y[low], depth - 1), self._grow(x[~low], y[~low], depth - 1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        def walk(t, row):
            while isinstance(t, tuple):
                t = t[2] if row[t[0]] <= t[1] else t[3]
            return t

        return np.array([sum(walk(t, row) for t in self.trees) / len(self.trees) for row in x])

    def flat(self) -> list[dict]:
        """Each tree as a full binary tree in arrays: node i has the children 2 i + 1 and 2 i + 2; leaves end it early."""
        out = []
        for t in self.trees:
            f, c, v = {}, {}, {}

            def fill(t, i, left, f=f, c=c, v=v):
                split = isinstance(t, tuple)
                f[i], c[i], v[i] = (t[0], t[1], 0.0) if split else (0, 0.0, t)
                if left:
                    fill(t[2] if split else t, 2 * i + 1, left - 1)
                    fill(t[3] if split else t, 2 * i + 2, left - 1)

            fill(t, 0, DEPTH)
            out.append({k: [x[i] for i in range(len(x))] for k, x in (("f", f), ("c", c), ("v", v))})
        return out

    def expression(self, x: Column) -> Column:
        """The mean leaf of all trees for the feature array x."""
        array = lambda values, kind: F.array(*(F.lit(y) for y in values)).cast(f"array<{kind}>")
        trees = F.array(*(F.struct(array(t["f"], "int").alias("f"), array(t["c"], "double").alias("c"), array(t["v"], "double").alias("v")) for t in self.flat()))

        def leaf(t):
            down = lambda i, _: i * 2 + F.when(x[t["f"][i]] <= t["c"][i], 1).otherwise(2)
            return t["v"][F.aggregate(F.sequence(F.lit(1), F.lit(DEPTH)), F.lit(0), down)]

        return F.aggregate(F.transform(trees, leaf), F.lit(0.0), lambda a, v: a + v) / len(self.trees)


def trained_forest(spark: SparkSession, findings: DataFrame | None = None, max_labelled: int = MAX_LABELLED) -> Forest:
    """A forest from findings (left, value, path, label): max_labelled at most, smallest hashes first; None: labelled_findings()."""
    if findings is None:
        findings = spark.createDataFrame(labelled_findings(), "left string, value string, path string, label int")
    cols = features(F.col("value"), F.col("left"), F.col("path"))
    rows = findings.where("value is not null and label in (0, 1)").orderBy(F.xxhash64("value", "left"), "value", "left", "path", "label").limit(max_labelled)
    rows = rows.select(*(cols[k].alias(k) for k in FEATURES), "label").collect()
    return Forest(np.array([r[:-1] for r in rows], float).reshape(len(rows), len(FEATURES)), np.array([r[-1] for r in rows], float))


def secret_candidates(docs: DataFrame, text: str = "text", path: str = "source", key: str = "doc_id") -> DataFrame:
    """(doc_id, path, line_no, value, parts) of what looks like a secret; line_no from 1, parts: the line around each place of value."""
    d = docs.select(F.col(key).alias("doc_id"), F.col(path).cast("string").alias("path"), F.posexplode(F.split(text, "\n")).alias("no", "line"))
    d = d.where(F.col("line").rlike(TOKEN) | F.col("line").rlike(NAMED))
    values = F.array_distinct(F.concat(F.regexp_extract_all("line", F.lit(f"({TOKEN})"), 1), F.regexp_extract_all("line", F.lit(NAMED), 1)))
    d = d.select("doc_id", "path", (F.col("no") + 1).cast("long").alias("line_no"), "line", F.explode(values).alias("value"))
    literal = F.concat(F.lit("\\Q"), F.replace("value", F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    return d.select("doc_id", "path", "line_no", "value", F.split("line", literal, -1).alias("parts"))


def secret_scan(docs: DataFrame, forest: Forest | None = None, threshold: float = 0.5, text: str = "text", path: str = "source", key: str = "doc_id") -> DataFrame:
    """Findings: doc_id, path, line_no, start, value, score; those that the forest gives threshold or more.

    Candidates are long runs of letters, digits and +/_=-, and values assigned to names like password or token. A value
    found twice on a line is one finding, at the place with the highest score, the first of equals; start is from 1. Null
    and empty texts have none, and lines are taken whole, however long. Repeated rows of a document repeat its findings.
    A value that holds another one is one more finding. Other columns are ignored, whatever their names. An empty table
    gives an empty result.
    """
    forest = forest or trained_forest(docs.sparkSession)
    d = secret_candidates(docs, text, path, key)
    once = lambda c: F.explode(F.array(c))  # noqa: E731  # worked out once: it keeps the optimizer from copying c into the trees
    value = features(F.col("value"), F.lit(""), F.col("path"))
    d = d.select("*", once(F.struct(*(value[k].cast("double").alias(k) for k in FEATURES if k not in OF_PLACE))).alias("ss_value"))

    def place(i):
        # NEAR characters before a place hold no more than NEAR / 8 earlier ones: a value has 8 at least.
        low = F.greatest(i - NEAR // 8, F.lit(1))
        left = F.substring(F.call_function("array_join", F.slice("parts", low, i - low + 1), F.col("value")), -NEAR, NEAR)
        return F.struct(*(features(F.col("value"), left, F.col("path"))[k].cast("double").alias(k) for k in OF_PLACE))

    d = d.select("*", once(F.transform(F.sequence(F.lit(1), F.size("parts") - 1), place)).alias("ss_places"))
    kinds = F.transform(F.array_distinct("ss_places"), lambda p: F.struct((-F.array_position("ss_places", p)).alias("at"), F.array(*(p[k] if k in OF_PLACE else F.col("ss_value")[k] for k in FEATURES)).alias("x")))
    scored = F.transform(kinds, lambda k: F.struct(F.round(forest.expression(k["x"]), 6).alias("score"), k["at"].alias("at")))
    d = d.select("*", once(F.array_max(scored)).alias("ss_best")).where(F.col("ss_best")["score"] >= threshold)
    at = -F.col("ss_best")["at"]
    before = F.aggregate(F.slice("parts", F.lit(1), at.cast("int")), F.lit(0).cast("long"), lambda n, x: n + F.length(x))
    start = before + (at - 1) * F.length("value") + 1
    return d.select("doc_id", "path", "line_no", start.cast("long").alias("start"), "value", F.col("ss_best")["score"].alias("score"))
