"""Operator 7: URL filters. Rules first; then a naive Bayes score of the words that a host and path are made of.

Names run together (cheappills) are split into words by the most likely path under a unigram model (Viterbi); a
multinomial naive Bayes model scores the words. Both models are small and fixed: they are fitted when a task starts.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankmill.llm.shared import mapped

#: (host, path, verdict). A rule fits its host and all below it, if the path starts with the rule's.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

# Names the model is fitted on unless the caller has a table of them; 1 is to be blocked.
LABELLED = (
    *((name, 1) for name in (
        "royal casino", "casino royale bonus", "mega casino spins", "online slots jackpot", "poker roulette blackjack", "football betting odds", "bet wager sports bets",
        "bingo lotto lottery", "gambling fortune", "lottery winners cash", "instant winner", "buy viagra cialis", "discount prescription drugs", "diet pills weight",
        "xanax tablets pharmacy", "steroids medication cheap pharmacy", "pills without prescription", "cheap replica watches", "fake luxury replicas", "counterfeit cigarettes",
        "adult video xxx", "adult webcam girls", "hot sexy singles", "naked girls nude", "porn sex fetish", "escorts hookup dating", "sex dating adult", "leaked nude webcams",
        "mail spam bulk", "spam spammer botnet", "seo backlinks rank", "doorway backlink seo", "ads network popup", "banner ads clicks", "ad tracker pixel", "click tracking ads",
        "popups banners track", "hidden trackers spyware", "payday loans instant cash", "bad credit loan fast", "bitcoin investment profit", "crypto pump coin scam",
        "forex millionaire earn money fast", "pyramid scam rich", "penny pump", "warez crack keygen", "cracked serial torrent", "torrents warez", "malware trojan exploit",
        "phishing virus keylogger", "hack hacked ransom", "free spins bonus", "free bet promo", "shady coupon clickbait",
        "link farm", "content farm backlinks", "click farm", "adult chat", "adult shop sex", "adult movie", "get viagra now", "escort service", "phishing login", "warez download", "diet pill shop",
    )),
    *((name, 0) for name in (
        "city news", "daily weather news", "science journal", "university research data", "public library", "history museum", "state government office", "art school",
        "music teacher lessons", "book reviews magazine", "family doctor health", "medical center care", "children hospital", "food recipe kitchen", "wine garden", "travel guide map",
        "mountain lake park", "river village hotel", "national park nature", "community forum", "software project code", "open data wiki", "computer language course", "student college work",
        "technology company", "business address directory", "local market shop", "sports team", "radio station", "film theater", "photo studio design", "social science paper",
        "home page", "the old town", "my blog", "women in science", "kids learn", "car design", "street view", "job list", "house plan", "green power water", "tree farm garden",
        "track field sports", "adult education", "rank order list", "credit union bank", "weight and size table", "drug research university", "law review", "security policy", "help and support",
        "contact form", "archive index", "article text", "event date", "world map", "press report", "product review", "price list", "gift card store", "game review",
    )),
)



def word_counts(labelled) -> dict[str, float]:
    """How often each word stands in labelled names."""
    counts: dict[str, float] = {}
    for name, _ in labelled:
        for w in name.split():
            counts[w] = counts.get(w, 0.0) + 1
    return counts


#: Words and counts that names are split by: those of the labelled names, unless the caller has counts of a corpus (unigram_counts).
VOCABULARY = word_counts(LABELLED)
#: Share of blocked names expected among all.
PRIOR = 0.2
#: Labelled names, and words of a corpus, that the models are fitted on at most.
MAX_LABELLED, MAX_WORDS = 20_000, 50_000
#: Added to each word's count in each class.
SMOOTHING = 0.1
MAX_WORD = 20
#: Labels at the start of a host, and at its end, that name no site.
PREFIXES = {"www", "m"}
SUFFIXES = {"com", "net", "org", "edu", "gov", "co", "io", "info", "example"}


#: Two-letter language codes (ISO 639-1) and sections, which tell nothing of what a path holds.
CODES = frozenset(
    "aa ab ae af ak am an ar as av ay az ba be bg bh bi bm bn bo br bs ca ce ch co cr cs cu cv cy da de dv dz ee el en eo es et eu fa ff fi fj fo "
    "fr fy ga gd gl gn gu gv ha he hi ho hr ht hu hy hz ia id ie ig ii ik io is it iu ja jv ka kg ki kj kk kl km kn ko kr ks ku kv kw ky la lb lg "
    "li ln lo lt lu lv mg mh mi mk ml mn mr ms mt my na nb nd ne ng nl nn no nr nv ny oc oj om or os pa pi pl ps pt qu rm rn ro ru rw sa sc sd se "
    "sg si sk sl sm sn so sq sr ss st su sv sw ta te tg th ti tk tl tn to tr ts tt tw ty ug uk ur uz ve vi vo wa wo xh yi yo za zh zu us gb pg".split()
)


class Segmenter:
    """Splits run-together names into words; unknown pieces cost more, the longer they are."""

    def __init__(self, vocabulary: dict[str, float] = VOCABULARY):
        total = sum(vocabulary.values())
        self.cost = {w: -math.log(c / total) for w, c in vocabulary.items()}
        self.unknown = -math.log(min(vocabulary.values()) / total)

    def split(self, name: str) -> list[str]:
        best, back = [0.0], [0]
        for end in range(1, len(name) + 1):
            options = []
            for start in range(max(0, end - MAX_WORD), end):
                w = name[start:end]
                cost = self.cost.get(w)
                options.append((best[start] + (cost if cost is not None else self.unknown + math.log(10) * len(w)), start))
            cost, start = min(options)
            best.append(cost)
            back.append(start)
        words, end = [], len(name)
        while end:
            words.append(name[back[end] : end])
            end = back[end]
        return words[::-1]


class NameModel:
    """Multinomial naive Bayes over the words of a host and a path."""

    def __init__(self, labelled=LABELLED, vocabulary: dict[str, float] | None = None, prior: float = PRIOR):
        self.segmenter, counts = Segmenter(vocabulary or word_counts(labelled)), ({}, {})
        for text, label in labelled:
            for w in text.split():
                counts[label][w] = counts[label].get(w, 0) + 1
        known = {*counts[0], *counts[1]}
        share = lambda label, w: (counts[label].get(w, 0) + SMOOTHING) / (sum(counts[label].values()) + SMOOTHING * len(known))
        self.weight = {w: math.log(share(1, w)) - math.log(share(0, w)) for w in known}
        self.prior = math.log(prior / (1 - prior))

    def words(self, host: str, path: str) -> list[str]:
        labels = host.split(".")
        while len(labels) > 1 and labels[-1] in SUFFIXES:
            labels.pop()
        if len(labels) > 1 and labels[0] in PREFIXES:
            labels.pop(0)
        found = []
        for piece in re.findall("[a-z]+", " ".join(labels)):
            found += self.segmenter.split(piece)
        for piece in re.findall("[a-z]+", path.lower()):
            # A letter is part of an id or a section, a code names a language; other pairs of letters are words or nothing.
            if len(piece) > 2:
                found += self.segmenter.split(piece)
            elif len(piece) == 2 and piece not in CODES:
                found.append(piece)
        return found

    def score(self, words: list[str]) -> float:
        x = self.prior + sum(self.weight.get(w, 0.0) for w in words)
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, x))))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: from the first :// to the next /, ? or # or the end, A-Z lower-cased; path: on from there to ? or #."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null. Rules are few: they are part of the plan."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _scored(labelled, vocabulary, prior):
    def run(batches):
        import pyarrow as pa

        model, known = NameModel(labelled, vocabulary, prior), {}
        for batch in batches:
            words, scores = [], []
            for host, path in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                w = known.get(host)
                if w is None:
                    w = model.words(host, "")
                    if len(known) < 100_000:  # a cache; what isn't in it is worked out again
                        known[host] = w
                w = w + model.words("", path)
                words.append(w)
                scores.append(model.score(w))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(words, pa.list_(pa.string())), pa.array(scores, pa.float64())], names=["page_id", "host", "path", "rule", "words", "score"])

    return run


def unigram_counts(docs: DataFrame, text: str = "text", limit: int = MAX_WORDS) -> dict[str, float]:
    """Counts of the limit most frequent words of docs, runs of a to z of up to MAX_WORD letters: a vocabulary for url_filter."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), 0)).alias("w")).where(F.length("w") <= MAX_WORD)
    top = words.groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(limit)
    return {r.w: float(r.n) for r in top.collect()}


def labelled_names(table: DataFrame, name: str = "name", label: str = "label", limit: int = MAX_LABELLED) -> tuple[tuple[str, int], ...]:
    """Names and labels (0 or 1) of a table, limit of them at most, those with the smallest hashes."""
    rows = table.where(F.col(name).isNotNull() & F.col(label).isin(0, 1)).select(F.lower(name).alias("n"), F.col(label).cast("int").alias("l"))
    return tuple((r.n, r.l) for r in rows.orderBy(F.xxhash64("n"), "n", "l").limit(limit).collect())


def url_filter(pages: DataFrame, rules=RULES, threshold: float = 0.5, labelled=LABELLED, vocabulary: dict[str, float] | None = None, prior: float = PRIOR, url: str = "url", key: str = "page_id") -> DataFrame:
    """Per page: page_id, host, path, rule (or null), words, score (probability of block) and verdict (block or allow).

    A url that is null, empty or without :// has an empty host and path, no words and the score of the prior. Urls are
    taken whole, however long. Of two rules that fit the longer wins; a score at the threshold blocks. Other columns are
    ignored, whatever their names; repeated rows each have a result; page_id is of its own type. An empty table gives an
    empty result. vocabulary: word counts to split names by, those of the labelled names without it.
    """
    host, path = host_and_path(F.col(url))
    kind = pages.schema[key].dataType.simpleString()
    d = pages.select(F.col(key).alias("page_id"), host.alias("host"), path.alias("path"))
    d = d.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)["rule"])
    d = mapped(d, _scored(labelled, vocabulary, prior), f"page_id {kind}, host string, path string, rule string, words array<string>, score double")
    verdict = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    for h, p, v in rules:
        verdict = F.when(F.col("rule") == h + p, v).otherwise(verdict)
    return d.withColumn("verdict", verdict)
