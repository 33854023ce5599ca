"""Pages of stuffed keywords, link lists and tags.

A page is cut into lines, long lines into pieces of ten words. A hidden Markov model labels each
piece as prose, link list, tag list or menu; a page is flagged by the share of words that lie in
link and tag lists, menus apart. The model is fitted to a bounded sample of labelled pages; what it
is applied to, and how, depends on no size.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.charsets import GONE, undone

#: Most labelled pages that the model is fitted to, taken by the hash of their id.
SAMPLE = 3000
#: Words of a piece; a Han or kana character counts as half a word.
PIECE = 10
#: Pages held at a time by a task.
SLICE = 256
SLICE_CHARS = 2_000_000
#: Limits tried against the labels: share of listed words, number of listed words.
SHARES, LEAST = (0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7), (10.0, 15.0, 20.0, 25.0, 30.0, 40.0)

#: States of the model. Records (tables, ingredients, timetables) are content as prose is.
PROSE, LINK, TAG, MENU, RECORD = range(5)
LABELS = ("prose", "link list", "tag list", "menu", "prose")

#: Function words of the languages crawled, which sentences need and lists lack.
FUNCTION_WORDS = {
    "en": "the a an and of that is was were it its but or by which who because when although only how about you we",
    "de": "der die das und ein eine dass in nach von zu ist den weshalb obwohl warum sie noch im",
    "fr": "le la les de des et un une que qui dans est on en du ce où à bien pourquoi depuis l",
    "es": "el la los de que y en un una es por se con no lo las aunque desde del cómo",
    "pl": "i w na z że się nie do jest jak dlaczego już choć przez po od roku o",
    "ru": "и в на не что он как это по уже с из у к за от хотя почему году",
    "ar": "في من على إلى أن التي الذي هذا كل عند لا ما لماذا رغم بعد و عن",
    "ja": "は が を に の で と も す ま",
    "zh": "的 了 在 是 和 把 有 不 这 着 也",
}
GLUE = frozenset(w for words in FUNCTION_WORDS.values() for w in words.split())

#: Characters that are words' parts by themselves (kana, Han), and scripts without spaces between words, whose runs count by length.
WIDE, UNSPACED = "\u3040-\u30ff\u3400-\u9fff", "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff"
#: Characters of a word of such a run; Han and kana count as half a word.
RUN = 5


def _class(test: Callable[[str], bool]) -> str:
    """The characters of the basic plane that pass a test, as ranges of a regular expression."""
    apart = re.compile(f"[{WIDE}{UNSPACED}]")
    points = np.array([i for i in range(0x80, 0xD800) if test(chr(i)) and not apart.match(chr(i))])
    edge = np.flatnonzero(np.diff(points) > 1)
    first, last = points[np.r_[0, edge + 1]], points[np.r_[edge, -1]]
    return "".join(f"\\u{i:04x}-\\u{j:04x}" for i, j in zip(first, last))


#: Letters of the other scripts, and the marks and joiners within their words.
LETTERS = "A-Za-z" + _class(lambda c: c.isalnum() and not c.isdecimal()) + "\\uf900-\\ufdff\\ufe70-\\uffef\\U00010000-\\U0001cfff\\U00020000-\\U000323af"
MARKS = _class(lambda c: unicodedata.category(c)[0] == "M") + "\\u200c\\u200d"
#: Scripts whose function words are known; in others their lack tells nothing.
SCRIPTS = frozenset(unicodedata.name(c, "").split(" ")[0] for w in GLUE for c in w if c.isalpha())
#: Units of amounts, sizes of goods, words that URLs and joined hash tags count for.
UNITS, SIZES = "ml|kg|mm|cm|g|x|EL", frozenset(("S", "M", "L", "XL", "XXL"))
URL_WORDS, HASH_WORDS = 3, 2
_WORD = f"[{LETTERS}][{LETTERS}{MARKS}]*"
TOKEN = re.compile(rf"\n|https?://\S+|[A-Za-z0-9+/=]{{30,}}|#\w[\w-]*|[{WIDE}]|[{UNSPACED}]+|\d[\d.,]*[ ]?(?:{UNITS})\b|[A-Z]{{2,}}-?\d+|{_WORD}(?:['’]{_WORD})*|\d[\d.,:]*|[^\w\s]")
ENDERS, SEPARATORS = frozenset(".!?。？！؟…।॥۔։።។။"), frozenset("|-–—»«·/,+*;>•~›،、")

BREAK, WORD, URL, HASH, CODE, NUMBER, TIME, ENDER, SEPARATOR, OTHER = range(10)
#: Bins of each feature; a symbol for a feature that tells nothing.
BINS = 5
MISSING = BINS
FEATURES = 11


def _foreign(c: str) -> bool:
    """Whether a letter's script has no known function words."""
    return not "\u3040" <= c <= "\u9fff" and unicodedata.name(c, "").split(" ")[0] not in SCRIPTS


def _kind(t: str) -> tuple[int, float, bool, bool, bool, bool]:
    """(kind, words, glue, capitalised, upper, foreign) of a token."""
    c = t[0]
    plain = (False, False, False, False)
    if c == "\n":
        return BREAK, 0, *plain
    if t.startswith("http") and "://" in t:
        return URL, URL_WORDS, *plain
    if len(t) >= 30 and t.isascii() and not t.isalpha():  # an unbroken run, no word
        return OTHER, 0, *plain
    if c == "#" and len(t) > 1:
        return HASH, HASH_WORDS, *plain
    if c.isdigit():
        if t[-1] == "." and len(t) <= 4 and t[:-1].isdigit():  # the number of a list's entry
            return SEPARATOR, 0, *plain
        return TIME if ":" in t.rstrip(":") or t[-1].isalpha() else NUMBER, 1, *plain
    if re.match(f"[{UNSPACED}]", c):
        return (WORD, len(t) / RUN, False, False, False, True) if any(map(str.isalpha, t)) else (OTHER, 0, *plain)
    if c.isalpha():
        if t[-1].isdigit() or t in SIZES:
            return CODE, 1, *plain
        low = t.lower()
        if low not in GLUE and all("\x80" <= ch < "ɐ" or "｡" <= ch <= "ﾟ" for ch in low):  # what a wrong charset leaves
            return OTHER, 0, *plain
        return WORD, 0.5 if "\u3040" <= c <= "\u9fff" else 1, low in GLUE, c.isupper() and len(t) > 1 and not t.isupper(), t.isupper() and len(t) > 2, _foreign(c)
    return ENDER if c in ENDERS else SEPARATOR if c in SEPARATORS else OTHER, 0, *plain


@dataclass
class Pieces:
    """Pieces of several pages: page of each (sorted), words, a symbol for each feature, and characters lost in decoding."""

    page: np.ndarray
    words: np.ndarray
    symbols: np.ndarray
    lost: np.ndarray


def _binned(x: np.ndarray, *edges: float) -> np.ndarray:
    return np.digitize(x, edges, right=True).astype(np.int8)


def pieces(texts: list[str | None]) -> Pieces:
    """The pieces of each text, decoded again where a wrong charset was taken; null and blank texts have none."""
    found = [TOKEN.findall(undone(t, GLUE)) if t else [] for t in texts]
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    if not sizes.sum():
        return Pieces(np.zeros(0, np.int64), np.zeros(0), np.zeros((0, FEATURES), np.int8), np.zeros(0))
    flat = [t for tokens in found for t in tokens]
    codes, unique = pd.factorize(np.array(flat, object))
    traits = [_kind(t) for t in unique]
    kind = np.array([t[0] for t in traits], np.int8)[codes]
    weight = np.array([t[1] for t in traits])[codes]
    glue, cap, upper, foreign = (np.array([t[i] for t in traits])[codes] for i in (2, 3, 4, 5))
    folded = pd.factorize(np.array([t.lower() for t in unique], object))[0][codes]
    page = np.repeat(np.arange(len(texts)), sizes)

    # where a line begins, and the words of the line so far
    new = np.r_[True, page[1:] != page[:-1]] | np.r_[False, kind[:-1] == BREAK]
    line = np.cumsum(new) - 1
    running = np.cumsum(weight)
    start = (running - weight)[new]
    within = (running - weight - start[line]) // PIECE
    gone = np.array([t == GONE for t in unique])[codes]
    keep = kind != BREAK
    kind, weight, glue, cap, upper, foreign, folded, page, line, within, gone = (x[keep] for x in (kind, weight, glue, cap, upper, foreign, folded, page, line, within, gone))
    if not len(kind):
        return Pieces(np.zeros(0, np.int64), np.zeros(0), np.zeros((0, FEATURES), np.int8), np.zeros(0))
    first = np.flatnonzero(np.r_[True, (line[1:] != line[:-1]) | (within[1:] != within[:-1])])
    add = lambda x: np.add.reduceat(x.astype(float), first)
    words = add(weight)

    # how often a word stands on its page
    total = np.bincount(page, weight, len(texts))
    unknown = np.bincount(page, weight * foreign, len(texts)) * 2 > total
    key = page * (int(folded.max()) + 1) + folded
    _, back, count = np.unique(key, return_inverse=True, return_counts=True)
    plain = (kind == WORD) & ~glue
    again = np.where(plain, (count[back] - 1) * weight / np.maximum(total[page], 1), 0)

    safe = np.maximum(words, 0.5)
    at_page = page[first]
    begin = np.searchsorted(at_page, np.arange(len(texts)))
    number = np.arange(len(first)) - begin[at_page]
    rest = np.bincount(at_page, minlength=len(texts))[at_page] - 1 - number
    short = words <= 2.5
    opens = np.r_[True, line[first][1:] != line[first][:-1]]
    closes = np.r_[opens[1:], True]
    url, tag, code = add(kind == URL), add(kind == HASH), add(kind == CODE)
    special = np.where(url > 0, 1, np.where(tag > 0, 2, np.where(code > 0, 3, np.where(add(kind == TIME) > 0, 4, 0))))
    ends = add(kind == ENDER)
    numbers = add((kind == NUMBER) | (kind == TIME)) / safe
    symbols = np.stack(
        [
            np.where(unknown[at_page], MISSING, _binned(add(glue * weight) / safe, 0, 0.12, 0.25)).astype(np.int8),
            _binned(add(kind == SEPARATOR) / safe, 0, 0.25, 0.6),
            special.astype(np.int8),
            _binned(add(again) / np.maximum(add(plain * weight), 0.5), 0.015, 0.04, 0.1),
            _binned(numbers, 0, 0.2, 0.4),
            _binned(words, 2, 5, 8.5),
            _binned(ends, 0, 1, 2),
            np.where(number < 3, 0, np.where((number < 12) & short, 1, np.where(rest < 3, 2, 3))).astype(np.int8),
            (opens * 2 + closes).astype(np.int8),
            _binned(add(kind == OTHER) / safe, 0, 0.1, 0.3),
            np.where(add(upper) / safe > 0.3, 3, _binned(add(cap) / safe, 0.05, 0.35)).astype(np.int8),
        ],
        axis=1,
    )
    solid = (words > 0) | (add(kind == OTHER) > 0)
    return Pieces(at_page[solid], words[solid], symbols[solid], add(gone)[solid])


def seeds(symbols: np.ndarray) -> np.ndarray:
    """First guess of each piece's state, or -1."""
    glue, sep, special, again, number, _, ends, place, _, _, _ = symbols.T
    guess = np.full(len(symbols), -1)
    guess[(glue >= 2) & (glue != MISSING)] = PROSE
    bare = glue == 0
    guess[bare & (number >= 2)] = RECORD
    guess[bare & (number <= 1) & ((again >= 2) | (sep >= 2)) & (place == 3)] = TAG
    few = (glue <= 1) | (glue == MISSING)
    guess[(special == 1) & few] = LINK
    guess[((special == 2) | (special == 3)) & few] = TAG
    guess[bare & (special == 4)] = RECORD
    guess[bare & (place <= 1) & (special == 0) & (again <= 1) & (number == 0) & (ends == 0)] = MENU
    return guess


@dataclass
class Model:
    """Logarithms of start, transition and emission probabilities; the least share and number of listed words of a flagged page."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray
    share: float
    least: float

    def scores(self, symbols: np.ndarray) -> np.ndarray:
        return sum(self.emit[f][:, symbols[:, f]] for f in range(FEATURES)).T


def _batches(page: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, there) of pages of about equal length, padded: arrays pages x pieces."""
    first = np.flatnonzero(np.r_[True, page[1:] != page[:-1]]) if len(page) else np.zeros(0, int)
    size = np.diff(np.r_[first, len(page)])
    order = np.argsort(size, kind="stable")
    for at in range(0, len(order), 64):
        own = order[at : at + 64]
        steps = np.arange(size[own].max())
        there = steps < size[own][:, None]
        yield np.where(there, first[own][:, None] + steps, 0), there


def label(model: Model, p: Pieces) -> np.ndarray:
    """The state of each piece on the likeliest path of its page."""
    out = np.zeros(len(p.page), np.int8)
    score = model.scores(p.symbols)
    for rows, there in _batches(p.page):
        n, steps = rows.shape
        best = model.start + score[rows[:, 0]]
        back = np.zeros((steps, n, 5), np.int8)
        back[0] = np.arange(5)
        for t in range(1, steps):
            ways = best[:, :, None] + model.move
            come = ways.argmax(1)
            on = there[:, t][:, None]
            back[t] = np.where(on, come, np.arange(5))
            best = np.where(on, np.take_along_axis(ways, come[:, None], 1)[:, 0] + score[rows[:, t]], best)
        state = best.argmax(1)
        for t in range(steps - 1, -1, -1):
            on = there[:, t]
            out[rows[on, t]] = state[on]
            state = back[t][np.arange(n), state]
    return out


def _expected(model: Model, p: Pieces, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece x state, start, transition) expected counts; bias is added to the pieces' scores."""
    score = model.scores(p.symbols) + bias
    weight = np.zeros((len(p.page), 5))
    start, move = np.zeros(5), np.zeros((5, 5))
    tr = np.exp(model.move)
    for rows, there in _batches(p.page):
        n, steps = rows.shape
        local = score[rows]
        local = np.exp(local - local.max(2, keepdims=True))
        ahead, scale = np.zeros((steps, n, 5)), np.ones((steps, n))
        ahead[0] = np.exp(model.start) * local[:, 0]
        for t in range(steps):
            if t:
                ahead[t] = np.where(there[:, t][:, None], (ahead[t - 1] @ tr) * local[:, t], ahead[t - 1])
            scale[t] = ahead[t].sum(1)
            ahead[t] /= scale[t][:, None]
        after = np.ones((n, 5))
        for t in range(steps - 1, -1, -1):
            on = there[:, t]
            both = ahead[t] * after
            both /= both.sum(1, keepdims=True)
            weight[rows[on, t]] = both[on]
            if t:
                pair = ahead[t - 1][:, :, None] * tr * (local[:, t] * after)[:, None, :]
                pair /= pair.sum((1, 2), keepdims=True)
                move += pair[on].sum(0)
                back = (local[:, t] * after) @ tr.T
                after = np.where(on[:, None], back / back.sum(1, keepdims=True), after)
            else:
                start += both.sum(0)
    return weight, start, move


def _emissions(weight: np.ndarray, symbols: np.ndarray, prior: float = 2.0) -> np.ndarray:
    counts = np.stack([np.stack([np.bincount(symbols[:, f], weight[:, s], BINS + 1)[:BINS] for s in range(5)]) for f in range(FEATURES)]) + prior
    return np.concatenate([np.log(counts / counts.sum(2, keepdims=True)), np.zeros((FEATURES, 5, 1))], 2)  # a missing feature weighs alike in every state


def listed(states: np.ndarray, p: Pieces, pages: int) -> tuple[np.ndarray, np.ndarray]:
    """(share, words) per page: of the words outside menus those in link and tag lists, and their number.

    Both are 0 for a page with more U+FFFD than words: its characters are lost and it can't be judged.
    """
    lists = np.bincount(p.page, p.words * ((states == LINK) | (states == TAG)), pages)
    content = np.bincount(p.page, p.words * (states != MENU), pages)
    lists[np.bincount(p.page, p.lost, pages) > np.bincount(p.page, p.words, pages)] = 0
    return lists / np.maximum(content, 1), lists


def fit(p: Pieces, stuffed: np.ndarray | None, rounds: int = 8, penalty: float = 2.5) -> Model:
    """A model from labelled pages: expectation maximisation from the seeds, in which a page's label weighs on its pieces' states.

    Pieces of pages labelled clean are less likely lists, those of stuffed pages less likely records,
    by ``penalty`` in the logarithm. Share and number of words are those that agree best with the
    labels. Without labels (None) the pieces count as they are and the limits are 0.5 and 20.
    """
    labelled = stuffed is not None
    stuffed = np.asarray(stuffed, bool) if labelled else np.zeros(int(p.page.max()) + 1 if len(p.page) else 0, bool)
    guess = seeds(p.symbols)
    weight = np.full((len(guess), 5), 0.02)
    known = guess >= 0
    weight[known, guess[known]] = 1
    model = Model(np.log(np.array([0.3, 0.05, 0.1, 0.5, 0.05])), np.log(np.full((5, 5), 0.04) + 0.8 * np.eye(5)), _emissions(weight, p.symbols, 5.0), 0.5, 20)
    bias = np.zeros((len(guess), 5))
    if labelled:
        y = stuffed[p.page]
        bias[:, [LINK, TAG]] -= penalty * ~y[:, None]
        bias[:, RECORD] -= penalty * y
    sure = np.isin(p.symbols[:, 2], (1, 2, 3)) & known  # links, hash tags and codes keep their first guess
    bias[sure, guess[sure]] += 2 * penalty
    for _ in range(rounds):
        weight, start, move = _expected(model, p, bias)
        model = Model(np.log((start + 1) / (start.sum() + 5)), np.log((move + 1) / (move + 1).sum(1, keepdims=True)), _emissions(weight + 0.002, p.symbols), model.share, model.least)
    if labelled and len(stuffed):
        share, words = listed(label(model, p), p, len(stuffed))
        limits = [(s, w) for s in SHARES for w in LEAST]
        wrong = [(((share >= s) & (words >= w)) != stuffed).mean() + 1e-4 * abs(s - 0.5) + 1e-6 * abs(w - 20) for s, w in limits]
        model.share, model.least = limits[int(np.argmin(wrong))]
    return model


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[list, list[str | None]]]:
    """(ids, texts) of a few pages at a time, by number and by size."""
    ids, texts = [], []
    room = SLICE_CHARS
    for i, t in zip(batch["i"].to_pylist(), batch["t"].to_pylist()):
        ids.append(i)
        texts.append(t)
        room -= len(t or "")
        if len(ids) == SLICE or room <= 0:
            yield ids, texts
            ids, texts, room = [], [], SLICE_CHARS
    if ids:
        yield ids, texts


def sample_pieces(documents: DataFrame) -> tuple[Pieces, list]:
    """The pieces of a few documents (doc_id, text), cut by the executors, and the ids in order of page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in _slices(batch):
                p = pieces(texts)
                edge = np.searchsorted(p.page, np.arange(len(ids) + 1))
                words = [p.words[a:b].astype("<f8").tobytes() for a, b in zip(edge, edge[1:])]
                lost = [p.lost[a:b].astype("<f8").tobytes() for a, b in zip(edge, edge[1:])]
                symbols = [p.symbols[a:b].tobytes() for a, b in zip(edge, edge[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch["i"].type), *(pa.array(x, pa.binary()) for x in (words, symbols, lost))], names=["i", "w", "s", "o"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.selectExpr("doc_id as i", "text as t").mapInArrow(run, f"i {kind}, w binary, s binary, o binary").toPandas().sort_values("i")
    words = [np.frombuffer(w, "<f8") for w in rows["w"]]
    symbols = [np.frombuffer(s, np.int8).reshape(-1, FEATURES) for s in rows["s"]]
    if not words:
        return pieces([]), []
    page = np.repeat(np.arange(len(words)), [len(w) for w in words])
    return Pieces(page, np.concatenate(words), np.concatenate(symbols), np.concatenate([np.frombuffer(o, "<f8") for o in rows["o"]])), list(rows["i"])


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model fitted to at most ``sample`` of the pages that ``labels`` (doc_id, stuffed) knows.

    Raters vote; ties, nulls and ids without page don't count. Pages are taken by the hash of their
    id. Without any label the model is fitted to as many pages as they are.
    """
    votes = labels.where("stuffed is not null").groupBy("doc_id").agg(F.avg("stuffed").alias("vote")).where("vote <> 0.5")
    chosen = votes.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    voted = {r["doc_id"]: r["vote"] > 0.5 for r in chosen.collect()}  # at most sample rows
    if not voted:
        p, _ = sample_pieces(documents.select("doc_id", "text").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
        return fit(p, None)
    p, ids = sample_pieces(documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id", "left_semi"))
    return fit(p, np.array([voted[i] for i in ids], bool))


def find_stuffed(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, share, words) of the flagged pages: share of listed words outside menus, and their number.

    Whole texts are labelled. Null and blank texts are never flagged; every copy of a page is. Other
    columns aren't read. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in _slices(batch):
                p = pieces(texts)
                share, words = listed(label(model, p), p, len(ids))
                hit = np.flatnonzero((share >= model.share) & (words >= model.least))
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch["i"].type).take(pa.array(hit)), pa.array(share[hit]), pa.array(words[hit])], names=["doc_id", "share", "words"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.selectExpr("doc_id as i", "text as t").mapInArrow(run, f"doc_id {kind}, share double, words double")
