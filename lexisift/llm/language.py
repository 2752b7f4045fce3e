"""Language identification by unigrams of pieces, summed over all segmentations of each word.

The vocabulary is a fixed public one of byte pieces. A language gives each piece a probability; a word's probability there is the
sum over all ways to cut it into pieces of the product of their probabilities, and a text's the product over its words. A
forward pass over the places of a word takes the sum: what reaches a place is what reaches an earlier one times the piece
between. All words of a batch take it together, a step for each byte of the longest word.

The probabilities are learned from every document that is not held out and has a language. Its words are counted by language;
``ROUNDS`` rounds of expectation and maximisation then share each counted word out among its segmentations, by a forward and a
backward pass, and add up what each piece gets. The sums lie in Spark; the driver has a number for each language and piece, bounded by
the vocabulary. Counts are smoothed by the pieces' shares over all languages, and those by equal shares. A text's score is the share of
the predicted language in the sum over all languages, by prior shares of the documents, with the text's evidence per word raised to
``EVIDENCE`` words at most, so that scores of long texts keep their meaning.

Words are stretches of letters and marks that begin with a letter, in lower case, with a space before them as the vocabulary has it.

Defined cases: a null text, or one without a letter, is ``und`` with score 0, as is every text where nothing was learned;
of languages with equal shares the first by bytes is taken; a null doc_id is not held out; documents without a language teach nothing; repeated
rows are each counted and scored; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexisift.llm.common import ship_package, slices, staged, utf8
from lexisift.llm.vectext import spread

PIECES = "byte_bpe_multi_50k.tiktoken"
ROUNDS, SMOOTH, FLOOR = 3, 200.0, 1e-9
EVIDENCE = 20.0
KEPT = 1 << 18  # words that a task counts, or has scored, before it starts anew
UNKNOWN = "und"
_LOW = 1e-100


class Trie:
    """The pieces as a trie: sorted (node, byte) keys, the node that each leads to, and the piece that ends there or -1."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            found = [(base64.b64decode(a), int(b)) for a, b in map(bytes.split, f)]
        nodes, edges, ends = 1, {}, {}
        for piece, rank in found:
            at = 0
            for byte in piece:
                key = at << 8 | byte
                to = edges.get(key)
                if to is None:
                    to = edges[key] = nodes
                    nodes += 1
                at = to
            ends[at] = rank
        keys = np.fromiter(edges, np.int64, len(edges))
        order = np.argsort(keys)
        self.keys, self.to = keys[order], np.fromiter(edges.values(), np.int64, len(edges))[order]
        self.piece = np.full(nodes, -1, np.int64)
        self.piece[list(ends)] = list(ends.values())
        self.size = max(r for _, r in found) + 1
        self.root = np.full(256, -1, np.int64)
        first = self.keys < 256
        self.root[self.keys[first]] = self.to[first]

    def arcs(self, raw: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(from, to, piece) of every piece in every word; raw holds the words, edge where they begin and the end. Places are
        numbered so that each word has one more than bytes."""
        size = np.diff(edge)
        word = np.repeat(np.arange(len(size)), size)
        stop = np.repeat(edge[1:], size)
        at = np.arange(len(raw))
        state, where = self.root[raw], at
        out, step = [], 1
        while len(where):
            live = state >= 0
            where, state = where[live], state[live]
            piece = self.piece[state]
            ends = piece >= 0
            base = where[ends] + word[where[ends]]
            out.append((base, base + step, piece[ends]))
            more = where + step < stop[where]
            where, state = where[more], state[more]
            key = state << 8 | raw[where + step]
            found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            state = np.where(self.keys[found] == key, self.to[found], -1)
            step += 1
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


@lru_cache(maxsize=2)
def trie(name: str = PIECES) -> Trie:
    return Trie(public_tokenizers.path(name))


def passed(source: np.ndarray, target: np.ndarray, far: np.ndarray, weight: np.ndarray, begin: np.ndarray, places: int) -> tuple[np.ndarray, np.ndarray]:
    """(sums, logs): of all paths from the begins to each place, the sum of the products of their weights is sums * exp(logs).

    weight: (kinds, arcs); far: how many bytes from its begin each target is. Sums of long words are scaled before they vanish.
    """
    kinds = len(weight)
    sums, logs = np.zeros((kinds, places)), np.zeros((kinds, places))
    sums[:, begin] = 1.0
    if not len(far):
        return sums, logs
    order = np.lexsort((target, far))
    source, target, far, weight = source[order], target[order], far[order], weight[:, order]
    cut = np.flatnonzero(np.concatenate([[True], far[1:] != far[:-1]])).tolist() + [len(far)]
    reach = int(np.abs(target - source).max())
    for a, b in zip(cut, cut[1:]):
        place = target[a:b]
        head = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        place = place[head]
        value = np.add.reduceat(sums[:, source[a:b]] * weight[:, a:b], head, axis=1)
        sums[:, place] = value
        logs[:, place] = logs[:, source[a:b][head]]
        for kind, i in zip(*np.nonzero(value < _LOW), strict=True):
            # all places from which a piece leads on get one scale
            own, back = place[i], np.arange(1, min(reach, far[a]) + 1) * (1 if source[a] > target[a] else -1)
            near = np.concatenate([[own], own + back])
            sums[kind, near] /= _LOW
            logs[kind, near] += np.log(_LOW)
    return sums, logs


def _offsets(arcs: tuple, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each word begins and ends among the places, and the word of each arc."""
    begin = edge[:-1] + np.arange(len(edge) - 1)
    return begin, edge[1:] + np.arange(len(edge) - 1), np.searchsorted(begin, arcs[0], "right") - 1


def scores(own: Trie, raw: np.ndarray, edge: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """(kinds, words): the log probability of each word; chance: (kinds, pieces)."""
    arcs = own.arcs(raw, edge)
    begin, end, word = _offsets(arcs, edge)
    sums, logs = passed(arcs[0], arcs[1], arcs[1] - begin[word], chance[:, arcs[2]], begin, len(raw) + len(begin))
    return np.log(sums[:, end]) + logs[:, end]


def expected(own: Trie, raw: np.ndarray, edge: np.ndarray, count: np.ndarray, kind: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """(kinds, pieces): how often each piece stands in the counted words, each of one kind, over all segmentations by their chances."""
    arcs = own.arcs(raw, edge)
    begin, end, word = _offsets(arcs, edge)
    places, weight = len(raw) + len(begin), chance[kind[word], arcs[2]][None]
    ahead, ahead_logs = passed(arcs[0], arcs[1], arcs[1] - begin[word], weight, begin, places)
    back, back_logs = passed(arcs[1], arcs[0], end[word] - arcs[0], weight, end, places)
    whole = np.log(ahead[0, end]) + ahead_logs[0, end]
    through = np.log(ahead[0, arcs[0]]) + ahead_logs[0, arcs[0]] + np.log(weight[0]) + np.log(back[0, arcs[1]]) + back_logs[0, arcs[1]]
    share = np.exp(through - whole[word]) * count[word]
    return np.bincount(kind[word] * own.size + arcs[2], share, len(chance) * own.size).reshape(len(chance), own.size)


def smoothed(counts: np.ndarray) -> np.ndarray:
    """Chances of the pieces by kind: counts, some of the shares over all kinds, and a floor for every piece."""
    every = counts.sum(0)
    every = every / max(every.sum(), 1.0)
    share = (counts + SMOOTH * every) / (counts.sum(1, keepdims=True) + SMOOTH)
    return (1 - FLOOR * counts.shape[1]) * share + FLOOR


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """1 for each code point that is a letter, 2 for each mark."""
    out = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((1, r"\p{L}"), (2, r"\p{M}")):
        out[[ord(c) for c in regex.findall(pattern, every)]] = kind
    return out


def words_of(texts: list) -> tuple[np.ndarray, pa.Array]:
    """(row, word) of all words of the texts: a letter and the letters and marks after it, in lower case."""
    raw, edge = utf8(pa.array(["" if t is None else t.lower() for t in texts], pa.large_string()))
    classes = _classes()
    kind = classes[:128][np.minimum(raw, 127)]
    lead = np.flatnonzero(raw >= 0xC0)
    if len(lead):
        head = raw[lead].astype(np.int64)
        more = 1 + (head >= 0xE0) + (head >= 0xF0)
        point = head & np.array([0, 0x1F, 0x0F, 0x07])[more]
        for k in (1, 2, 3):
            point = np.where(more >= k, point << 6 | (raw[np.minimum(lead + k, len(raw) - 1)] & 0x3F), point)
        own = classes[point]
        kind[lead] = own
        for k in (1, 2, 3):
            kind[lead[more >= k] + k] = own[more >= k]
    inside = kind > 0
    first = np.zeros(len(raw) + 1, bool)
    first[edge[:-1]] = True
    before = np.concatenate([[False], inside[:-1]])[: len(raw)]
    start = np.flatnonzero(inside & (~before | first[:-1]))
    stop = np.flatnonzero(inside & (np.concatenate([~inside[1:], [True]])[: len(raw)] | first[1:])) + 1
    letter = np.flatnonzero(kind == 1)
    if not len(letter):
        return np.zeros(0, np.int64), pa.array([], pa.large_string())
    at = np.minimum(np.searchsorted(letter, start), len(letter) - 1)
    fine = (letter[at] >= start) & (letter[at] < stop)
    start, stop = letter[at][fine], stop[fine]
    size = stop - start
    bounds = np.zeros(len(start) + 1, np.int64)
    np.cumsum(size, out=bounds[1:])
    letters = raw[spread(start, size)]
    found = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(bounds), pa.py_buffer(letters))
    return np.searchsorted(edge, start, "right") - 1, found


def _packed(words) -> tuple[np.ndarray, np.ndarray]:
    """The words, each with a space before it, as bytes, and where they begin."""
    return utf8(pc.binary_join_element_wise(pa.scalar("", pa.large_string()), words.cast(pa.large_string()), pa.scalar(" ", pa.large_string())))


def is_held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def counted(train: DataFrame) -> DataFrame:
    """(lang, word, n): the words of all texts, counted in their task before they are shuffled."""

    schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])

    def added(parts):
        got = pa.concat_tables(parts).group_by(["lang", "word"]).aggregate([("n", "sum")])
        return pa.table({"lang": got.column("lang"), "word": got.column("word"), "n": got.column("n_sum")})

    def run(batches):
        parts, size = [], 0
        for batch in batches:
            _, edge = utf8(batch.column("text"))
            for a, b in slices(edge):
                row, word = words_of(batch.column("text").slice(a, b - a).to_pylist())
                if not len(row):
                    continue
                lang, word = batch.column("lang").slice(a, b - a).dictionary_encode(), word.dictionary_encode()
                wide = len(word.dictionary)
                cell, n = np.unique(lang.indices.to_numpy()[row].astype(np.int64) * wide + word.indices.to_numpy(), return_counts=True)
                parts.append(pa.table({"lang": lang.dictionary.take(pa.array(cell // wide)), "word": word.dictionary.take(pa.array(cell % wide)), "n": n}))
                size += len(n)
                if size > KEPT:
                    parts = [added(parts)]
                    size = 0
                    if parts[0].num_rows > KEPT:
                        yield from parts[0].cast(schema).to_batches(1 << 16)
                        parts = []
        if parts:
            yield from added(parts).cast(schema).to_batches(1 << 16)

    rows = train.select("lang", "text").mapInArrow(run, "lang string, word string, n long")
    return rows.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _shared(words: DataFrame, langs: list[str], chance: np.ndarray, vocabulary: str) -> np.ndarray:
    """The expected counts of all counted words: added up in each task, then by language and piece."""
    sent = words.sparkSession.sparkContext.broadcast((langs, chance))

    def run(batches):
        names, own = sent.value
        kinds, pieces = {x: i for i, x in enumerate(names)}, trie(vocabulary)
        total = np.zeros(own.shape)
        for batch in batches:
            raw, edge = _packed(batch.column("word"))
            n = batch.column("n").to_numpy().astype(float)
            kind = np.array([kinds[x] for x in batch.column("lang").to_pylist()], np.int64)
            for a, b in slices(edge, 1 << 18):
                total += expected(pieces, raw[edge[a] : edge[b]], edge[a : b + 1] - edge[a], n[a:b], kind[a:b], own)
        kind, piece = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int64()), pa.array(piece, pa.int64()), pa.array(total[kind, piece])], ["kind", "piece", "x"])

    sums = words.mapInArrow(run, "kind long, piece long, x double").groupBy("kind", "piece").agg(F.sum("x").alias("x")).toArrow()
    out = np.zeros(chance.shape)
    out[sums.column("kind").to_numpy(), sums.column("piece").to_numpy()] = sums.column("x").to_numpy()
    return out


def learned(train: DataFrame, rounds: int = ROUNDS, vocabulary: str = PIECES) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, log shares of their documents, chances of the pieces by language)."""
    share = sorted((r["lang"].encode(), r["n"]) for r in train.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect())  # a row per language
    langs = [x.decode() for x, _ in share]
    own = trie(vocabulary)
    chance = np.full((len(langs), own.size), 1.0 / own.size)
    if langs:
        words = staged(counted(train), "language-words")
        for _ in range(rounds):
            chance = smoothed(_shared(words, langs, chance, vocabulary))
    n = np.array([n for _, n in share], float)
    return langs, np.log(n / n.sum()) if langs else n, chance


class Scored:
    """The words that a task has scored already, a column of logs each; beyond ``KEPT`` words it starts anew."""

    def __init__(self, pieces: Trie, chance: np.ndarray):
        self.pieces, self.chance = pieces, chance
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.logs = np.zeros((len(self.chance), 1 << 12))

    def of(self, words: pa.Array) -> np.ndarray:
        """(kinds, words)."""
        if len(self.at) > KEPT:
            self.clear()
        own = words.to_pylist()
        new = [i for i, w in enumerate(own) if w not in self.at]
        if new:
            raw, edge = _packed(words.take(pa.array(new)))
            fresh = [scores(self.pieces, raw[edge[a] : edge[b]], edge[a : b + 1] - edge[a], self.chance) for a, b in slices(edge, 1 << 18)]
            begin = len(self.at)
            while begin + len(new) > self.logs.shape[1]:
                self.logs = np.concatenate([self.logs, np.zeros_like(self.logs)], axis=1)
            self.logs[:, begin : begin + len(new)] = np.concatenate(fresh, axis=1)
            self.at.update(zip([own[i] for i in new], range(begin, begin + len(new)), strict=True))
        return self.logs[:, [self.at[w] for w in own]]


def identified(docs: DataFrame, rounds: int = ROUNDS, vocabulary: str = PIECES) -> DataFrame:
    """The language of every document and its share, learned from those that are not held out."""
    spark = docs.sparkSession
    ship_package(spark)
    train = docs.where(F.col("lang").isNotNull() & ~is_held_out(F.col("doc_id"))).select("lang", "text")
    langs, prior, chance = learned(train, rounds, vocabulary)
    sent = spark.sparkContext.broadcast((langs, prior, chance))

    def run(batches):
        names, before, own = sent.value
        known = Scored(trie(vocabulary), own)
        for batch in batches:
            _, offsets = utf8(batch.column("text"))
            for a, b in slices(offsets):
                n = b - a
                doc, word = words_of(batch.column("text").slice(a, n).to_pylist())
                count = np.bincount(doc, minlength=n)
                lang, score = [UNKNOWN] * n, np.zeros(n)
                if count.any() and names:
                    every = word.dictionary_encode()
                    logs = known.of(every.dictionary)
                    which = every.indices.to_numpy()
                    total = np.stack([np.bincount(doc, row[which], n) for row in logs], 1)
                    some = np.flatnonzero(count)
                    total = total[some] * np.minimum(1.0, EVIDENCE / count[some])[:, None] + before
                    total -= total.max(1, keepdims=True)
                    share = np.exp(total)
                    best = share.argmax(1)
                    score[some] = (share / share.sum(1, keepdims=True))[np.arange(len(some)), best]
                    for i, k in zip(some.tolist(), best.tolist(), strict=True):
                        lang[i] = names[k]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, n), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
    return rows.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
