"""Phrase collocations: generalised suffix automata per shard, counts reduced globally.

A text is cut into pieces at marks and line ends, and a phrase is a run of words within a piece. Each shard
(some megabytes of pieces) makes the suffix automaton of its pieces up to the longest phrase and reads the
distinct phrases with the sizes of their sets of end places off it. Counts of shards are added up in Spark.

1. The shards send hashes of their word pairs. Pairs with enough occurrences mark a bitmap; a hash that two
   pairs share marks too much, never too little.
2. The shards send words, and phrases all of whose pairs are marked, as text. Summed, these counts are exact.
3. A phrase is cut after each of its words; the cut whose parts explain it best (the lowest score) counts.
4. Along its suffix link (the phrase without its first word) and to its parent (without its last) a phrase
   tells the next shorter ones how frequent it is; those that mostly occur inside it go. Counts only fall as
   phrases grow, so that the next longer phrases decide for all longer ones.

Nothing is collected by word, phrase or language: sums and the first ranks of a language start in the tasks,
and joins on hot words are plain shuffles, which adaptive execution splits. The bitmap grows with the number
of frequent pairs up to a fixed size; beyond it step 2 sends more phrases that fail, with the same result.

Defined cases: a null or empty text has no words; a null language is ``und``; repeated rows count as often as
they occur; a text of any length is cut at marks, so a shard is larger than its size only by one piece; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagplane.llm.common import LOWER, UPPER, table, written
from tagplane.llm.words import U64, lowered, mix, span_hashes, text_buffers

LONGEST, LEAST, INSIDE_PERCENT, TOP = 3, 10, 50, 2000
NO_LANG = "und"
#: Bytes of text that one automaton is made of, about.
SHARD_BYTES = 2 << 20
#: Bits of the bitmap for each frequent pair, and at most.
BITS_PER_PAIR, MOST_BITS = 16, 1 << 27
_BREAK, _BLANK = np.zeros(256, bool), np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(10, 14)]] = True
_BLANK[[9, 32]] = True


@dataclass
class Level:
    """The distinct substrings of one length: their parents (without the last symbol) and last symbols,
    their suffix links (without the first symbol), how often they end, and the states that they are in."""

    parent: np.ndarray
    symbol: np.ndarray
    link: np.ndarray
    count: np.ndarray
    state: np.ndarray


class SuffixAutomaton:
    """Generalised suffix automaton of runs of symbols, for substrings of bounded length.

    It is made level by level: a substring is a transition from its parent by its last symbol, and two
    substrings are one state if they end at the same places. As the places of a substring are among those of
    its suffix link, they are one state if both end equally often. Sorting makes each level for all runs at once.
    """

    def __init__(self, symbols: np.ndarray, opens: np.ndarray, longest: int) -> None:
        """``opens`` marks the symbols with which a run begins."""
        n, at = int(symbols.max()) + 1 if len(symbols) else 0, np.arange(len(symbols))
        self.levels = [Level(np.zeros(n, np.int64), np.arange(n), np.full(n, -1), np.bincount(symbols, minlength=n), np.arange(n))]
        self.n_states = n
        depth = at - np.maximum.accumulate(np.where(opens, at, 0)) if len(at) else at
        node = symbols.astype(np.int64)  # of the substring of the last length that ends here
        for length in range(2, longest + 1):
            ends = np.flatnonzero(depth >= length - 1)
            key, first, inverse, count = np.unique(node[ends - 1] * n + symbols[ends], return_index=True, return_inverse=True, return_counts=True)
            before, link = self.levels[-1], node[ends[first]]
            same = before.count[link] == count
            state = np.where(same, before.state[link], self.n_states + np.cumsum(~same) - 1)
            self.n_states += int((~same).sum())
            self.levels.append(Level(key // max(n, 1), key % max(n, 1), link, count, state))
            node = np.full(len(symbols), -1)
            node[ends] = inverse

    def symbols_of(self, length: int, nodes: np.ndarray) -> list[np.ndarray]:
        """First to last symbol of some substrings of a length."""
        out = []
        for level in self.levels[length - 1 :: -1]:
            out.append(level.symbol[nodes])
            nodes = level.parent[nodes]
        return out[::-1]


@dataclass
class Shard:
    """The automaton of the pieces of some texts; a symbol is a word in a language."""

    automaton: SuffixAutomaton
    words: pa.Array  # of each symbol
    lang: np.ndarray  # of each symbol
    hashes: np.ndarray  # of each symbol
    langs: list[str]
    n_words: np.ndarray  # in each language

    @staticmethod
    def of(data: np.ndarray, offsets: np.ndarray, lang_of_text: np.ndarray, langs: list[str], longest: int) -> Shard:
        """``offsets`` are the starts of texts within the data, and its end."""
        data = lowered(data)
        breaks = _BREAK[data]
        word = ~(breaks | _BLANK[data])
        begins = np.zeros(len(data) + 1, bool)
        begins[offsets] = True
        starts_here, ends_here = word.copy(), word.copy()
        starts_here[1:] &= ~word[:-1] | begins[1:-1]
        ends_here[:-1] &= ~word[1:] | begins[1:-1]
        starts, ends = np.flatnonzero(starts_here), np.flatnonzero(ends_here) + 1
        text = np.searchsorted(offsets, starts, side="right") - 1
        piece = np.cumsum(breaks)[starts] + text
        spelled = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)), pa.py_buffer(data[word])])
        coded = spelled.dictionary_encode()
        distinct, symbols = np.unique(lang_of_text[text].astype(np.int64) * max(len(coded.dictionary), 1) + coded.indices.to_numpy(), return_inverse=True)
        which, lang = distinct % max(len(coded.dictionary), 1), distinct // max(len(coded.dictionary), 1)
        opens = np.ones(len(starts), bool)
        opens[1:] = piece[1:] != piece[:-1]
        raw, at = text_buffers(coded.dictionary)
        raw_langs, lang_at = text_buffers(pa.array(langs, pa.string()))
        hashes = mix(span_hashes(raw, at[:-1], at[1:])[which] + mix(span_hashes(raw_langs, lang_at[:-1], lang_at[1:]))[lang])
        n_words = np.bincount(lang, np.bincount(symbols, minlength=len(distinct)), len(langs)).astype(np.int64)
        return Shard(SuffixAutomaton(symbols, opens, longest), coded.dictionary.cast(pa.large_string()).take(pa.array(which)), lang, hashes, langs, n_words)

    def pair_hashes(self) -> np.ndarray:
        level = self.automaton.levels[1]
        return (mix(self.hashes[level.parent] * U64(0x9E3779B97F4A7C15) + self.hashes[level.symbol]) >> U64(1)).astype(np.int64)

    def phrases(self, length: int, nodes: np.ndarray) -> list[pa.Array]:
        """lang, size, phrase, n of some substrings of a length."""
        words = [self.words.take(pa.array(x)) for x in self.automaton.symbols_of(length, nodes)]
        lang = pa.array(self.langs, pa.string()).take(pa.array(self.lang[self.automaton.symbols_of(length, nodes)[0]]))
        phrase = pc.binary_join_element_wise(*words, pa.scalar(" ", pa.large_string())) if length > 1 else words[0]
        return [lang, pa.array(np.full(len(nodes), length, np.int32)), phrase.cast(pa.string()), pa.array(self.automaton.levels[length - 1].count[nodes].astype(np.int64))]


def shards(batches: Iterator[pa.RecordBatch], longest: int, size: int) -> Iterator[Shard]:
    """Shards of batches(text, lang). A text is cut where a shard is full, after a mark or line end; pieces stay whole."""
    for batch in batches:
        data, offsets = text_buffers(batch.column(0))
        coded = batch.column(1).dictionary_encode()
        langs, lang_of_text = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        start, end = 0, len(data)
        while start < end:
            stop = end
            if end - start > size:
                texts = offsets[(offsets > start) & (offsets <= start + size)]
                marks = np.flatnonzero(_BREAK[data[start : start + size]]) if not len(texts) else ()
                if len(texts):
                    stop = int(texts[-1])
                elif len(marks):
                    stop = start + int(marks[-1]) + 1
                else:  # one piece that is longer
                    later = int(offsets[np.searchsorted(offsets, start, side="right")])
                    far = np.flatnonzero(_BREAK[data[start:later]])
                    stop = start + int(far[0]) + 1 if len(far) else later
            first = int(np.searchsorted(offsets, start, side="right")) - 1
            inside = offsets[(offsets > start) & (offsets < stop)]
            own = np.concatenate([[start], inside, [stop]]) - start
            # Texts without a byte have one offset in common; the last of them is the one that begins there.
            texts_here = np.searchsorted(offsets, own[:-1] + start, side="right") - 1
            texts_here[0] = first
            yield Shard.of(data[start:stop], own, lang_of_text[texts_here], langs, longest)
            start = stop


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"))


def marked_pairs(docs: DataFrame, least: int = LEAST, shard_bytes: int = SHARD_BYTES) -> np.ndarray:
    """Bitmap of the hashes of word pairs with ``least`` occurrences: a power of two of bits in words of 64."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches, 2, shard_bytes):
            hashes = shard.pair_hashes()
            yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(shard.automaton.levels[1].count.astype(np.int64))], ["hash", "n"])
            del shard, hashes  # before the next one is made

    sums = _rows(docs).mapInArrow(pairs, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    frequent = written(sums.where(F.col("n") >= least).select("hash"), "frequent-pairs")
    bits = 64
    while bits < min(BITS_PER_PAIR * frequent.count(), MOST_BITS):
        bits *= 2
    place = F.col("hash").bitwiseAND(F.lit(bits - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))
    # As many rows as the bitmap has words, at most.
    found = frequent.select(F.call_function("div", place, F.lit(64)).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bitmap = np.zeros(bits // 64, np.int64)
    bitmap[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return bitmap.view(np.uint64)


def phrase_counts(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """lang, size, phrase, n: words and phrases with ``least`` occurrences, and under size 0 the words of each language."""
    spark = docs.sparkSession
    bitmap = spark.sparkContext.broadcast(marked_pairs(docs, least, shard_bytes))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = bitmap.value
        mask = U64(len(marks) * 64 - 1)
        names = ["lang", "size", "phrase", "n"]
        for shard in shards(batches, longest, shard_bytes):
            yield pa.RecordBatch.from_arrays([pa.array(shard.langs, pa.string()), pa.array(np.zeros(len(shard.langs), np.int32)), pa.array([""] * len(shard.langs)), pa.array(shard.n_words)], names)
            levels = shard.automaton.levels
            yield pa.RecordBatch.from_arrays(shard.phrases(1, np.arange(len(levels[0].count))), names)
            at = shard.pair_hashes().astype(U64) & mask
            may = (marks[(at >> U64(6)).astype(np.int64)] >> (at & U64(63))) & U64(1) > 0
            yield pa.RecordBatch.from_arrays(shard.phrases(2, np.flatnonzero(may)), names)
            for length in range(3, longest + 1):
                # All pairs of a phrase are marked if those of its parent and of its suffix link are.
                level = levels[length - 1]
                may = may[level.parent] & may[level.link]
                yield pa.RecordBatch.from_arrays(shard.phrases(length, np.flatnonzero(may)), names)
            del shard, levels, at, may  # before the next one is made

    made = _rows(docs).mapInArrow(count, "lang string, size int, phrase string, n long")
    return made.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("size") == 0))


def _times(*factors: Column) -> Column:
    """Exact product beyond 64 bits."""
    out = factors[0].cast("decimal(18,0)")
    for f in factors[1:]:
        out = out * f.cast("decimal(18,0)")
    return out


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, inside_percent: int = INSIDE_PERCENT, top: int = TOP, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the best phrases of 2 to ``longest`` words of docs(text, lang)."""
    found = written(phrase_counts(docs, longest, least, shard_bytes), "phrase-counts")
    counts = found.where("size > 0").select("lang", "phrase", "n")
    candidates = found.where("size > 1").select("lang", "size", "phrase", F.col("n").alias("a"))
    words = F.split("phrase", " ", -1)
    join = lambda begin, n: F.concat_ws(" ", F.slice(words, begin, n))
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", join(1, F.col("k")).alias("left"), join(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    for side, c in (("left", "l"), ("right", "r")):
        cuts = cuts.join(counts.select("lang", F.col("phrase").alias(side), F.col("n").alias(c)), ["lang", side])
    score = F.call_function("div", _times(F.col("a"), F.col("a")) * F.lit(1_000_000).cast("decimal(7,0)"), _times(F.col("l"), F.col("r")))
    scored = cuts.select("lang", "phrase", "a", F.struct(score.alias("score"), "k", "l", "r").alias("cut"), F.lit(None).cast("long").alias("longer"))
    # A phrase tells its parent and its suffix link how often it occurs.
    inner = F.explode(F.array(join(1, F.col("size") - 1), join(2, F.col("size") - 1)))
    told = candidates.where("size > 2").select("lang", inner.alias("phrase"), F.lit(None).cast("long").alias("a"), F.lit(None).cast(scored.schema["cut"].dataType).alias("cut"), F.col("a").alias("longer"))
    best = scored.unionByName(told).groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.min("cut").alias("cut"), F.max("longer").alias("longer"))
    kept = best.where(F.coalesce(F.col("longer") * 100 < F.col("a") * inside_percent, F.lit(True))).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    first = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    sizes = found.where("size = 0").select("lang", "n")
    return first.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_suffix_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = collocations(table(spark, sf_dir, "documents"))
    return out.withColumn("rank", F.col("rank").cast("long"))


OP11_ORACLE = rf"""with d as (select coalesce(lang, '{NO_LANG}') as lang, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') as text from documents),
s as (select lang, unnest(regexp_split_to_array(text, '[.,;:!?
-
]')) as piece from d),
p as (select lang, regexp_extract_all(piece, '[^ 	]+') as w from s),
g as (select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as phrase from p cross join (values (1), (2), (3)) as v(k) where len(w) >= k),
f as (select lang, k, phrase, count(*) as f from g group by all),
n as (select lang, sum(len(w)) as n from p group by all),
cand as (select *, string_split(phrase, ' ') as w from f where k >= 2 and f >= {LEAST}),
cut as (select c.lang, c.phrase, c.f as a, j, x.f as l, y.f as r, 1000000::hugeint * c.f * c.f // (x.f::hugeint * y.f) as score
  from (select *, unnest(range(1, k)) as j from cand) c join f x on x.lang = c.lang and x.phrase = array_to_string(w[1:j], ' ') join f y on y.lang = c.lang and y.phrase = array_to_string(w[j + 1:c.k], ' ')),
one as (select * from cut qualify row_number() over (partition by lang, phrase order by score, j) = 1),
told as (select lang, phrase, max(f) as longer from (select lang, f, unnest([array_to_string(w[1:k - 1], ' '), array_to_string(w[2:k], ' ')]) as phrase from cand where k > 2) group by all),
kept as (select one.* from one left join told using (lang, phrase) where longer is null or 100 * longer < {INSIDE_PERCENT} * a),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select lang, rank, phrase, a, l, r, cast(n.n as bigint) as n, cast(score as bigint) as score from ranked join n using (lang) where rank <= {TOP}"""
