"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built of labelled text. A text is parsed against it: from
where the last phrase ended, the longest match is the next phrase. The language that needs the
fewest phrases, in proportion to what it needs for text of its own kind, wins.

The automata of all languages form one sparse table, a hash table of (state, letter) to state, so
any number of letters and languages has room. Texts are cut into pieces of ``PIECE`` letters that are
parsed side by side, one letter of each at a step. A piece's first phrases may begin elsewhere than
in a parse of the whole text, so the parse of the piece before is carried on into it until both
begin a phrase at the same letter; from there on they agree. The few that don't soon agree are carried on
one by one, through as many pieces as it takes. What comes out is the parse of the whole text, whatever the
pieces.

Scale: fitted on at most ``SAMPLE`` labelled documents of each language (those of least hashed id),
from which ``LETTERS`` make the automaton and as many the norm. Every sampled document gives an even
share, short ones pass on what they lack, and a share is a span from anywhere in its text. Documents
are only mapped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_mod, need
from .text import CHUNK

#: Bounds of the fit: labelled documents of each language, and letters of the automaton and of the norm.
SAMPLE, LETTERS = 200, 30_000
PIECE = 512
#: Flags of a batch of pieces: letters times pieces times languages.
FLAGS = 1 << 25
#: So many parses are carried on one by one, more of them side by side.
FEW = 200
LETTER = regex.compile(r"\p{L}")
_SPACE, _OTHER = 0, 1
_SPREAD = 0x9E3779B1


class Table:
    """(state, letter) to state, as open addressing over 64-bit keys; -1 where there is none."""

    def __init__(self, states: np.ndarray, letters: np.ndarray, to: np.ndarray, width: int):
        keys = states.astype(np.int64) * width + letters
        self.width = width
        self.kind = np.int32 if not len(keys) or keys.max() < 1 << 31 else np.int64
        keys = keys.astype(self.kind)
        size = 1 << max(4, int(3 * len(keys)).bit_length())
        self.shift = np.uint32(33 - size.bit_length())
        self.mask, self.cells = size - 1, np.full((size, 2), -1, self.kind)  # key and state together, for one access
        left, step = np.arange(len(keys)), 0
        while len(left):
            at = (self._slot(keys[left]) + step) & self.mask
            free = np.flatnonzero(self.cells[at, 0] < 0)
            taken, first = np.unique(at[free], return_index=True)
            chosen = free[first]
            self.cells[taken, 0], self.cells[taken, 1] = keys[left[chosen]], to[left[chosen]]
            left = np.delete(left, chosen)
            step += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint32) * np.uint32(_SPREAD)) >> self.shift).astype(np.intp)

    def find(self, states: np.ndarray, letters: np.ndarray) -> np.ndarray:
        keys = (states * self.kind(self.width) + letters).ravel()
        at = self._slot(keys)
        cells = self.cells.take(at, axis=0)
        held, out = cells[:, 0], cells[:, 1].copy()
        other = held != keys
        out[other] = -1
        other &= held >= 0
        open_ = other.nonzero()[0]
        at, keys = at[open_], keys[open_]
        while len(open_):
            at = (at + 1) & self.mask
            cells = self.cells.take(at, axis=0)
            held = cells[:, 0]
            hit = held == keys
            out[open_[hit]] = cells[hit, 1]
            more = ((held >= 0) & ~hit).nonzero()[0]
            open_, at, keys = open_[more], at[more], keys[more]
        return out.reshape(states.shape)


def automaton(text: list[int]) -> list[dict[int, int]]:
    """The suffix automaton of a text: of each state its letters and next states; state 0 is the root."""
    link, length = [-1], [0]
    move: list[dict[int, int]] = [{}]
    last = 0
    for c in text:
        new = len(move)
        move.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at != -1 and c not in move[at]:
            move[at][c] = new
            at = link[at]
        if at != -1:
            q = move[at][c]
            if length[q] == length[at] + 1:
                link[new] = q
            else:
                copy = len(move)
                move.append(dict(move[q]))
                length.append(length[at] + 1)
                link.append(link[q])
                while at != -1 and move[at].get(c) == q:
                    move[at][c] = copy
                    at = link[at]
                link[q] = link[new] = copy
        last = new
    return move


@dataclass
class Model:
    languages: list[str]
    points: np.ndarray  # code points of the letters known, sorted; letter k + 2
    table: Table
    roots: np.ndarray
    first: np.ndarray  # of each language and letter, the state from the root, or the root
    norm: np.ndarray  # phrases a letter that each language needs for its own text

    def __post_init__(self):
        # letters by code point; all above the last are unknown
        self.letters = np.full(max(0x3001, int(self.points.max(initial=0)) + 1) + 1, _OTHER, np.int32)
        self.letters[self.points] = np.arange(len(self.points)) + 2
        self.letters[_BLANKS] = _SPACE

    def encode(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letters = self.letters.take(np.minimum(points, np.uint32(len(self.letters) - 1)))
        keep = np.ones(len(letters), bool)
        keep[1:] = (letters[1:] != _SPACE) | (letters[:-1] != _SPACE)
        return letters[keep]

    def _step(self, state: np.ndarray, letters: np.ndarray, again: np.ndarray, roots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and where a phrase begins with these letters: at ``again``. At a root nothing is pending.

        ``again`` is the root itself for a letter that the language hasn't got: a phrase alone.
        """
        to = self.table.find(state, letters)
        fresh = to < 0
        fresh |= state == roots
        np.copyto(to, again, where=fresh)
        return to, fresh

    def phrases(self, texts: list[np.ndarray], piece: int = PIECE) -> np.ndarray:
        """For each text and language, the number of phrases of its parse."""
        count = np.zeros((len(texts), len(self.roots)), np.int64)
        pieces = [(k, a) for k, t in enumerate(texts) for a in range(0, len(t), piece)]
        most = max(1, FLAGS // (piece * max(1, len(self.roots))))
        at = 0
        while at < len(pieces):
            to = min(len(pieces), at + most)
            while to < len(pieces) and to > at + 1 and pieces[to][1]:  # whole texts, unless one is more than a batch
                to -= 1
            if to < len(pieces) and pieces[to][1]:
                to = next((k for k in range(to, len(pieces)) if not pieces[k][1]), len(pieces))
            self._parse(texts, pieces[at:to], piece, count)
            at = to
        return count

    def _parse(self, texts: list[np.ndarray], pieces: list[tuple[int, int]], piece: int, count: np.ndarray) -> None:
        """Adds up the phrases of whole texts."""
        n, many = len(pieces), len(self.roots)
        size = np.array([min(piece, len(texts[k]) - a) for k, a in pieces])
        order = np.argsort(-size, kind="stable")
        row = np.empty(n, np.int64)
        row[order] = np.arange(n)
        lengths = size[order]
        grid = np.zeros((int(lengths[0]), n), self.table.kind)
        for r, p in enumerate(order.tolist()):
            k, a = pieces[p]
            grid[: lengths[r], r] = texts[k][a : a + piece]
        roots = self.roots[:, None]
        state = np.repeat(roots, n, 1)
        begins = np.zeros((int(lengths[0]), many, n), bool)
        alone = np.zeros((many, n), np.int64)
        having = np.searchsorted(-lengths, -np.arange(len(grid)), "left").tolist()  # pieces that have a letter at a step
        for t, m in enumerate(having):
            letters = grid[t, :m]
            state[:, :m], fresh = self._step(state[:, :m], letters, self.first.take(letters, axis=1), roots)
            begins[t, :, :m] = fresh
            alone[:, :m] += fresh
        total = alone.copy()
        # carry each piece's parse on into the next one of its text until both begin a phrase at a letter
        owner = np.array([k for k, _ in pieces])
        goes_on = 1 + np.flatnonzero(owner[1:] == owner[:-1])
        piece_of, lang = np.repeat(goes_on, many), np.tile(np.arange(many), len(goes_on))
        at, own = row[piece_of], state[lang, row[piece_of - 1]]
        t, open_ = 0, []  # those that reach the end of a piece without agreeing, and those left when few are
        while len(at):
            over = lengths[at] <= t
            if len(at) <= FEW or over.any():
                over |= len(at) <= FEW
                open_ += zip(piece_of[over].tolist(), lang[over].tolist(), own[over].tolist(), [t] * int(over.sum()), strict=True)
                at, lang, own, piece_of = at[~over], lang[~over], own[~over], piece_of[~over]
                continue
            letters = grid[t, at]
            own, fresh = self._step(own, letters, self.first[lang, letters], self.roots[lang])
            other = begins[t, lang, at]
            total[lang, at] += fresh.astype(np.int64) - other
            left = ~(fresh & other)
            at, lang, own, piece_of = at[left], lang[left], own[left], piece_of[left]
            t += 1
        if open_:
            self._carry_on(sorted(open_), owner, row, lengths, grid, begins, alone, total)
        np.add.at(count, owner, total[:, row].T)

    def _carry_on(self, open_: list[tuple[int, int, int, int]], owner: np.ndarray, row: np.ndarray, lengths: np.ndarray, grid: np.ndarray, begins: np.ndarray, alone: np.ndarray, total: np.ndarray) -> None:
        """Carries parses (piece, language, state, letters done) on one by one until they agree or their text ends."""
        cells, width, shift, mask, spread = memoryview(self.table.cells.reshape(-1)), self.table.width, int(self.table.shift), self.table.mask, _SPREAD
        agreed: dict[tuple[int, int], int] = {}
        for p, lang, state, t in open_:
            if p <= agreed.get((int(owner[p]), lang), -1):  # an earlier parse went through this piece
                continue
            root, first, text = int(self.roots[lang]), self.first[lang].tolist(), owner[p]
            settled = False
            while True:
                r, more = row[p], 0
                end = int(lengths[r])
                for letter, other in zip(grid[t:end, r].tolist(), begins[t:end, lang, r].tolist(), strict=True):
                    key = state * width + letter
                    slot = 2 * ((key * spread & 0xFFFFFFFF) >> shift)
                    while (held := cells[slot]) != key and held >= 0:
                        slot = slot + 2 & 2 * mask
                    if held < 0 or state == root:
                        if other:
                            settled = True
                            break
                        more += 1
                        state = first[letter]
                    else:
                        more -= other
                        state = cells[slot + 1]
                total[lang, r] += more
                if settled or p + 1 == len(owner) or owner[p + 1] != text:
                    break
                p, t = p + 1, 0
                total[lang, row[p]] = alone[lang, row[p]]  # what came of a parse that this one replaces
            agreed[int(text), lang] = p

    def judge(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score) of each text; the score is the winner's share against the others."""
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        some = [k for k, text in enumerate(texts) if text and self.languages and LETTER.search(text)]
        if some:
            for k, phrases in zip(some, self.phrases([self.encode(texts[k]) for k in some]), strict=True):
                need_ = phrases / self.norm
                best = int(np.argmin(need_))
                # each phrase too many halves a language's weight
                weight = np.exp2(-np.minimum((need_ - need_[best]) * float(self.norm.mean()), 60.0))
                out[k] = self.languages[best], float(weight[best] / weight.sum())
        return out


_BLANKS = np.array([i for i in range(0x3001) if chr(i).isspace()], np.uint32)


def _flat(text: str) -> str:
    return " ".join(text.lower().split())


def shares(lengths: list[int], letters: int) -> list[int]:
    """An even share of ``letters`` for each text; what short ones lack goes to the others."""
    out, left = [0] * len(lengths), letters
    for place, k in enumerate(sorted(range(len(lengths)), key=lambda k: lengths[k])):
        out[k] = min(lengths[k], left // (len(lengths) - place))
        left -= out[k]
    return out


def fit(documents: DataFrame, sample: int = SAMPLE, letters: int = LETTERS) -> Model:
    """From (doc_id, text, lang) rows with a language; rows without a letter teach nothing.

    Of rows that share a language and doc_id one is read, that with the first text by code point of its span.
    """
    spark = documents.sparkSession
    rows = documents.where(F.col("lang").isNotNull() & (F.col("lang") != "und") & F.col("text").rlike(r"\p{L}"))
    rows = rows.select("lang", "text", F.coalesce("doc_id", F.lit("")).alias("id")).withColumn("h", F.xxhash64("id"))
    size = rows.groupBy("lang").agg(F.approx_count_distinct("id").alias("ids"))
    # hashes are spread evenly, so about four times the sample lies below this bound
    share = size.select(F.col("lang").alias("l"), (F.lit(4.0 * sample) / F.col("ids") * 2.0**31).alias("most"))
    near = rows.join(F.broadcast(share), F.col("lang") == F.col("l")).where(F.pmod("h", F.lit(1 << 31)) <= F.col("most"))
    ids = near.groupBy("lang", "id", "h").agg(F.max(F.length("text")).alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "id"))
    chosen = sorted(ids.withColumn("rank", rank).where(F.col("rank") <= sample).select("lang", "rank", "id", "n").collect())  # a sample of ids for each language
    by: dict[str, list] = {}
    for r in chosen:
        by.setdefault(r["lang"], []).append(r)
    wanted = []
    for own in by.values():
        for half in (own[::2], own[1::2]):  # those of the automaton and those of the norm
            wanted += [(r["lang"], r["id"], r["rank"], k) for r, k in zip(half, shares([r["n"] for r in half], letters), strict=True) if k]
    if not wanted:
        return build({})
    table = spark.createDataFrame(wanted, "l string, i string, rank int, share int")
    spans = rows.join(F.broadcast(table), (F.col("lang") == F.col("l")) & (F.col("id") == F.col("i")))
    begin = F.expr("cast(pmod(xxhash64(id, 1), greatest(length(text) - share, 0) + 1) + 1 as int)")
    spans = spans.select("lang", "rank", F.substring(F.col("text"), begin, F.col("share")).alias("t")).groupBy("lang", "rank").agg(F.min("t").alias("t"))
    texts: dict[str, tuple[list[str], list[str]]] = {}
    for lang, rank, t in sorted(map(tuple, spans.collect())):  # LETTERS letters twice for each language
        texts.setdefault(lang, ([], []))[(rank - 1) % 2].append(_flat(t))
    return build(texts)


def build(by: dict[str, tuple[list[str], list[str]]]) -> Model:
    """The model of languages, each with texts for its automaton and texts for its norm (the same ones where there are none)."""
    languages = sorted(by)
    train = {k: " ".join(by[k][0]) for k in languages}
    other = {k: " ".join(by[k][1]) or train[k] for k in languages}
    points = np.array(sorted({ord(c) for t in train.values() for c in t if LETTER.match(c)}), np.uint32)
    width = len(points) + 2
    none = np.zeros(0, np.int64)
    model = Model(languages, points, Table(none, none, none, width), none, none, np.ones(len(languages)))
    roots, firsts = [], []
    states, letters, to, base = [], [], [], 0
    for k, lang in enumerate(languages):
        moves = automaton(model.encode(train[lang]).tolist())
        roots.append(base)
        for s, row in enumerate(moves):
            states += [base + s] * len(row)
            letters += row.keys()
            to += [base + x for x in row.values()]
        firsts.append([base + moves[0].get(c, 0) for c in range(width)])
        base += len(moves)
    model.table = Table(np.array(states, np.int64), np.array(letters, np.int64), np.array(to, np.int64), width)
    model.roots = np.array(roots, model.table.kind)
    model.first = np.array(firsts, model.table.kind)
    for k, lang in enumerate(languages):
        text = model.encode(other[lang])
        model.norm[k] = max(model.phrases([text])[0, k] / max(1, len(text)), 1e-3)
    return model


def identify(documents: DataFrame, held_out: Column, sample: int = SAMPLE, letters: int = LETTERS) -> DataFrame:
    """``row`` (every column of ``documents``), held_out, lang_pred and score.

    Learns from rows where ``held_out`` is false and lang isn't null. Null texts and those without a
    letter are ``und`` with score 0, and so is everything when there is nothing to learn from.
    """
    whole = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    whole = whole.select("row", "held_out", F.col("row.text").cast("string").alias("text"))
    model = fit(need(documents.where(~F.coalesce(held_out, F.lit(False))), doc_id="string", text="string", lang="string"), sample, letters)
    held = documents.sparkSession.sparkContext.broadcast(model)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found, part, size = batch.column("text"), [], [], 0
            for x in texts:
                part.append(x.as_py())
                size += len(part[-1] or "")
                if size > CHUNK // 2:
                    found += held.value.judge(part)
                    part, size = [], 0
            found += held.value.judge(part)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("held_out"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["row", "held_out", "lang_pred", "score"])

    return whole.mapInArrow(read, whole.select("row", "held_out").schema.add("lang_pred", "string").add("score", "double"))


def op7(spark, sf_dir: str) -> DataFrame:
    docs = need(spark.read.parquet(f"{sf_dir}/documents.parquet"), doc_id="long", text="string", lang="string")
    return identify(docs, crc_mod("doc_id", 3) == 1).select("row.doc_id", "held_out", "lang_pred", "score")
