"""Many-pattern matching against a vocabulary and segmentation by it.

Vocabularies up to a checked size are broadcast as an automaton that reads each text once; above it `dictionary_hits` joins the
windows of a text to the words, so any size works. Segmentation takes the cover of
disjoint words with the largest sum of weights, of equal sums the one of fewer words, then of the earlier ones.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..udf import row_udf

#: Words that may be broadcast as an automaton; beyond it segmentation raises and hits are joined.
MOST_WORDS = 2_000_000


class Automaton:
    """Aho-Corasick over code points: all hits (begin, end, value)."""

    def __init__(self, words: dict[str, object]):
        import ahocorasick

        self.words = words
        self.machine = ahocorasick.Automaton()
        for w, v in words.items():
            if w:
                self.machine.add_word(w, (len(w), v))
        if len(self.machine):
            self.machine.make_automaton()

    def hits(self, text: str) -> list[tuple[int, int, object]]:
        if not len(self.machine):
            return []
        return sorted((end + 1 - n, end + 1, v) for end, (n, v) in self.machine.iter(text))

    def leftmost_longest(self, text: str) -> list[tuple[int, int, object]]:
        """From the left, at each place the longest hit that begins there and doesn't overlap the one before."""
        out, reach = [], 0
        for b, e, v in sorted(self.hits(text), key=lambda h: (h[0], -h[1])):
            if b >= reach:
                out.append((b, e, v))
                reach = e
        return out

    def longest(self, text: str) -> tuple[int, int, object] | None:
        return max(self.hits(text), key=lambda h: (h[1] - h[0], -h[0]), default=None)

    def matches(self, text: str) -> bool:
        return bool(len(self.machine)) and next(self.machine.iter(text), None) is not None


def best_cover(hits: list[tuple[int, int, float]], n: int) -> list[tuple[int, int, float]]:
    """Disjoint hits with the largest sum of values, by dynamic programming over the n places."""
    by_end: dict[int, list] = {}
    for h in hits:
        by_end.setdefault(h[1], []).append(h)
    score, words, back = [0.0] * (n + 1), [0] * (n + 1), [None] * (n + 1)
    for e in range(1, n + 1):
        score[e], words[e] = score[e - 1], words[e - 1]
        for h in sorted(by_end.get(e, ()), key=lambda h: h[0]):
            value = (score[h[0]] + h[2], -(words[h[0]] + 1))
            if value > (score[e], -words[e]) or (back[e] is None and value == (score[e], -words[e]) and h[2] > 0):
                score[e], words[e], back[e] = value[0], -value[1], h
    out, e = [], n
    while e:
        if back[e] is not None:
            out.append(back[e])
            e = back[e][0]
        else:
            e -= 1
    return out[::-1]


def cut(text: str, machine: Automaton, digits: bool = False) -> list[str]:
    """Words of the cover and what lies between them; with digits, runs of digits in between are cut in twos from the right."""
    out, at = [], 0
    for begin, end, _ in [*best_cover([h for h in machine.hits(text) if h[1] - h[0] > 1], len(text)), (len(text), len(text), 0)]:
        while at < begin:
            stop = at + 1
            if text[at].isascii() and text[at].isalnum():
                while stop < begin and text[stop].isascii() and text[stop].isalnum() and text[stop].isdigit() == text[at].isdigit():
                    stop += 1
            piece = text[at:stop]
            if digits and piece.isdigit() and len(piece) > 2:
                odd = len(piece) % 2
                out += ([piece[0]] if odd else []) + [piece[i : i + 2] for i in range(odd, len(piece), 2)]
            else:
                out.append(piece)
            at = stop
        if end > begin:
            out.append(text[begin:end])
        at = end
    return out


def checked(vocabulary: DataFrame, word_col: str = "word", value_col: str = "weight") -> dict[str, object]:
    """The vocabulary on the driver, once its size is known to be small enough to be broadcast."""
    if (n := vocabulary.count()) > MOST_WORDS:
        raise ValueError(f"a vocabulary of {n} words is too large for broadcast; join dictionary_hits instead")
    return {r[0]: r[1] for r in vocabulary.select(word_col, value_col).collect()}


def segmenter(spark, words: dict[str, float], spaces: bool = False, digits: bool = False):
    """An Arrow function from text to words; spaces: keep blanks as tokens."""
    shared = spark.sparkContext.broadcast(words)

    @row_udf("array<string>", setup=True)
    def run():
        machine = Automaton(shared.value)
        return lambda t: [w for w in cut(t or "", machine, digits) if spaces or w.strip()]

    return run


LABELS = tuple("header phrase triple codon field number".split())


def tagger(spark, labelled: dict[str, tuple[str, float]]):
    """An Arrow function from text to labelled spans, from word -> (label, score)."""
    shared = spark.sparkContext.broadcast(labelled)

    @row_udf("array<struct<begin:int,end:int,label:string>>", setup=True)
    def run():
        machine = Automaton(shared.value)
        one = lambda t: [{"begin": b, "end": e, "label": label} for b, e, _, label in ((h[0], h[1], h[2], shared.value[t[h[0] : h[1]]][0]) for h in best_cover([(b, e, float(v[1])) for b, e, v in machine.hits(t)], len(t)))]
        return lambda t: one(t or "")

    return run


def dictionary_hits(docs: DataFrame, vocabulary: DataFrame, id_col: str = "doc_id", text_col: str = "text", word_col: str = "word", most: int = MOST_WORDS, longest: bool = False) -> DataFrame:
    """id, begin, end, word of all overlapping occurrences, or of the longest ones only: at each place that no longer hit to the left covers, the longest word there.

    Up to `most` distinct words are broadcast as an automaton, which reads each text once and shuffles nothing; above
    that, windows of the vocabulary's lengths are joined to its words.
    """
    words = vocabulary.select(F.col(word_col).alias("word")).where(F.length("word") > 0).distinct()
    n = words.count()
    if n > most:
        if longest:
            raise ValueError(f"a vocabulary of {n} words is too large for broadcast, which longest matches need")
        return _joined_hits(docs, words, id_col, text_col).withColumnRenamed("word", word_col)
    shared = docs.sparkSession.sparkContext.broadcast([r[0] for r in words.collect()])

    @row_udf("array<struct<begin:int,end:int,word:string>>", setup=True)
    def run():
        machine = Automaton(dict.fromkeys(shared.value, 0))
        return lambda t: [{"begin": b, "end": e, "word": t[b:e]} for b, e, _ in (machine.leftmost_longest(t) if longest else machine.hits(t))] if t else []

    return docs.select(id_col, F.explode(run(text_col)).alias("h")).select(id_col, "h.begin", "h.end", F.col("h.word").alias(word_col))


def _joined_hits(docs: DataFrame, words: DataFrame, id_col: str, text_col: str) -> DataFrame:
    lengths = sorted(r[0] for r in words.select(F.length("word").alias("n")).distinct().collect())
    t = F.col(text_col)
    places = docs.select(id_col, t.alias("_t"), F.explode(F.array(*map(F.lit, lengths))).alias("n")).where(F.length("_t") >= F.col("n"))
    places = places.select(id_col, "_t", "n", F.explode(F.sequence(F.lit(0), F.length("_t") - F.col("n"))).alias("begin"))
    grams = places.select(id_col, "begin", (F.col("begin") + F.col("n")).alias("end"), F.substring("_t", F.col("begin") + 1, F.col("n")).alias("word"))
    return grams.join(words, "word").select(id_col, "begin", "end", "word")


def word_counts(docs: DataFrame, words) -> DataFrame:
    """word, n over an array column; words of one character are left out."""
    return docs.select(F.explode(words).alias("word")).where(F.length("word") > 1).groupBy("word").agg(F.count("*").alias("n"))


def weights(counts: DataFrame) -> DataFrame:
    return counts.select("word", F.sqrt(F.col("n") * F.length("word")).alias("weight"))


def normalize_weights(vocabulary: DataFrame, supremum: float | None = None, unit: bool = False) -> DataFrame:
    """weights over sqrt(min * max); with supremum, raised so that the largest becomes it; with unit, over the largest."""
    bounds = vocabulary.agg(F.min("weight").alias("low"), F.max("weight").alias("high"))
    middle = F.sqrt(F.col("low") * F.col("high"))
    w, top = F.col("weight") / middle, F.col("high") / middle
    if supremum is not None:
        power = F.when(top == 1, 1.0).otherwise(F.lit(math.log(supremum)) / F.log(top))
        w, top = F.pow(w, power), F.pow(top, power)
    return vocabulary.join(F.broadcast(bounds)).select("word", (w / top if unit else w).alias("weight"))  # one row is broadcast


def reconcile(old: DataFrame, new: DataFrame) -> DataFrame:
    """word, action: delete for words of old that new lacks, insert for the others' way round."""
    gone = old.join(new, "word", "left_anti").select("word", F.lit("delete").alias("action"))
    return gone.unionByName(new.join(old, "word", "left_anti").select("word", F.lit("insert").alias("action")))


def adjust_weights(vocabulary: DataFrame, step: float = 0.01) -> DataFrame:
    """A word outweighs the words it contains: its weight, or the heaviest contained one's and a step if that is more. All substrings are joined, so words are bounded by their length, not each other."""
    n = F.length("word")
    inside = vocabulary.select("word", F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda size: F.transform(F.sequence(F.lit(1), F.length("word") - size + 1), lambda i: F.substring("word", i, size))))).alias("part")).where("part <> word").distinct()
    heaviest = inside.join(vocabulary.select(F.col("word").alias("part"), F.col("weight").alias("part_weight")), "part").groupBy("word").agg(F.max("part_weight").alias("most"))
    return vocabulary.join(heaviest, "word", "left").select("word", F.greatest("weight", F.coalesce(F.col("most") + step, F.col("weight"))).alias("weight"))
