"""Texts with passages that were decoded in a wrong character encoding.

A multinomial classifier over hashed byte bigrams is trained on words of the corpus itself, garbled
along every encoding chain of a list. For each word with characters beyond ASCII it names the
chain, or none; the chain is inverted, and a word counts as restored only if every byte
decodes strictly.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass, field, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbstone.runtime import materialise, salted_join

#: Distinct texts whose words train the classifier: a bound on training alone.
TRAINING_ROWS = 6_000
#: Bytes of those rows.
TRAINING_BYTES = 64 << 20
#: Hash buckets of the bigrams.
BUCKETS = 1 << 15
#: Log odds a word must gain by strict decoding as UTF-8, which right text hardly ever allows.
MARGIN = 2.0
#: Log odds a run of words must gain where any byte decodes, as between two single-byte encodings.
RUN_MARGIN = 12.0
#: Characters beyond ASCII such a run must have; fewer fit several readings.
RUN_CHARS = 3
#: Log odds and share of decodable bytes from which a word counts as UTF-8 with lost bytes.
LOST_MARGIN, LOST_SHARE = 8.0, 0.5
#: How many times as often one reading of a word must be seen as the other to speak for it, and the gain that
#: does without such words.
OFTEN, UNSEEN_MARGIN = 5, 30.0
#: Share of words taken for garbled beforehand.
PRIOR = 0.02
_SMOOTHING = 0.02

#: Encodings that bytes of UTF-8 are mistaken for, single-byte mistakes (written
#: in the first, read in the second), and chains of two mistakes with UTF-8.
UTF8_READ_AS = ("cp1252", "latin-1", "cp1250", "iso8859-2", "cp1251", "koi8-r", "cp437", "cp850", "cp866", "mac-roman", "iso8859-15", "cp1254")
SINGLE_BYTE = (
    ("cp1251", "cp1252"), ("cp1251", "latin-1"), ("cp1251", "koi8-r"), ("cp1251", "cp866"), ("cp1251", "mac-roman"), ("cp1251", "cp437"), ("cp1251", "cp850"), ("cp1251", "iso8859-5"),
    ("koi8-r", "cp1251"), ("koi8-r", "cp1252"), ("koi8-r", "latin-1"), ("koi8-r", "cp866"), ("koi8-r", "mac-roman"),
    ("cp866", "cp1251"), ("cp866", "cp1252"), ("cp866", "latin-1"), ("cp866", "koi8-r"),
    ("cp1252", "cp1251"), ("cp1252", "mac-roman"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "cp1250"), ("cp1252", "koi8-r"), ("cp1252", "cp866"),
    ("mac-roman", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"),
    ("gbk", "cp1252"), ("gbk", "latin-1"), ("gbk", "cp1251"), ("utf-8", "gbk"), ("big5", "gbk"),
)
TWICE = (("cp1252", "cp1252"), ("latin-1", "latin-1"), ("latin-1", "cp1252"), ("cp1252", "latin-1"), ("cp1251", "cp1251"), ("mac-roman", "mac-roman"), ("cp437", "cp437"), ("cp850", "cp850"), ("cp1250", "cp1250"))
Chain = tuple[tuple[str, str], ...]
#: Mistakes that lose bytes, as the reader puts U+FFFD for what it can't read.
LOSSY: tuple[Chain, ...] = tuple(((a, f"{b} with losses"),) for a, b in (("utf-8", "ascii"), ("cp1252", "utf-8"), ("cp1251", "utf-8"), ("koi8-r", "utf-8"), ("cp866", "utf-8"), ("gbk", "utf-8")))
CHAINS: tuple[Chain, ...] = (*((("utf-8", b),) for b in UTF8_READ_AS), *((p,) for p in SINGLE_BYTE), *((("utf-8", a), ("utf-8", b)) for a, b in TWICE))
_CLASSES = CHAINS + LOSSY

_HOLES: dict[str, dict[int, str]] = {}


def _tables(encoding: str) -> tuple[str, dict[int, int]]:
    """Byte to character and back; bytes an encoding leaves undefined keep their number, as browsers read them."""
    if encoding not in _HOLES:
        chars = []
        for b in range(256):
            try:
                chars.append(bytes([b]).decode(encoding))
            except UnicodeDecodeError:
                chars.append(chr(b))
        _HOLES[encoding] = {"to": "".join(chars), "back": {ord(c): chr(b) for b, c in reversed([*enumerate(chars)])}}
    return _HOLES[encoding]["to"], _HOLES[encoding]["back"]


def _read(data: bytes, encoding: str) -> str:
    if encoding in ("gbk", "utf-8"):
        return data.decode(encoding)
    return data.decode("latin-1").translate(_tables(encoding)[0])


def _bytes(text: str, encoding: str) -> bytes:
    if encoding in ("gbk", "utf-8", "big5"):
        return text.encode(encoding)
    back = _tables(encoding)[1]
    if any(ord(c) not in back for c in text):
        raise UnicodeEncodeError(encoding, text, 0, 1, "no such character")
    return text.translate(back).encode("latin-1")


def garble(text: str, chain: Chain) -> str:
    """What becomes of a text when each (written, read) step of the chain is taken; UnicodeError where it can't be."""
    for written, read in chain:
        if read.endswith(" with losses"):
            text = _bytes(text, written).decode(read.removesuffix(" with losses"), "replace") if written != "utf-8" else text.encode().decode(read.removesuffix(" with losses"), "replace")
            continue
        text = _read(_bytes(text, written) if written != "utf-8" else text.encode(), read)
    return text


def restore(text: str, chain: Chain) -> str:
    """The text before the chain; UnicodeError unless every byte decodes strictly."""
    for written, read in reversed(chain):
        data = _bytes(text, read)
        text = data.decode(written) if written in ("utf-8", "gbk", "big5") else _read(data, written)
    return text


def recovered_share(text: str, chain: Chain) -> float:
    """Share of the bytes beyond ASCII that belong to a character of UTF-8, whole or begun, if the first step
    wrote UTF-8 and some bytes are lost."""
    data = b""
    for written, read in reversed(chain):
        if written != "utf-8":
            return 0.0
        back = _tables(read)[1]
        data = "".join(back.get(ord(c), "\xff") for c in text).encode("latin-1")
        text = data.decode("utf-8", "replace")
    high = sum(b > 0x7F for b in data)
    good = at = 0
    while at < len(data):
        lead = data[at]
        most = 1 + (0xC2 <= lead) + (0xE0 <= lead) + (0xF0 <= lead) if lead < 0xF5 else 1
        size = 1
        while size < most and at + size < len(data) and 0x80 <= data[at + size] < 0xC0:
            size += 1
        good += size if size > 1 else 0
        at += size
    return good / high if high else 0.0


def bigrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of every byte bigram with a byte beyond ASCII; word borders count as bytes."""
    joined = np.frombuffer(b"\n" + b"\n".join(words) + b"\n", np.uint8).astype(np.uint32)
    pair = joined[:-1] << 8 | joined[1:]
    ends = np.cumsum([len(w) + 1 for w in words])
    use = np.nonzero((joined[:-1] > 0x7F) | (joined[1:] > 0x7F))[0]
    word = np.searchsorted(ends, use, side="right")
    # the bigram that ends a word belongs to it, not to the next
    word = np.minimum(word, len(words) - 1)
    return word, (pair[use] * np.uint32(2654435761) >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int64)


@dataclass(frozen=True)
class Classifier:
    """``weights[b, c]``: log probability of bucket b in class c; class 0 is right text, then CHAINS, then LOSSY. ``seen``: how
    often each word, in small letters and without punctuation, occurs in the training words taken for right."""

    weights: np.ndarray
    prior: np.ndarray
    seen: Counter
    right: dict[str, float] = field(default_factory=dict, compare=False)

    def scores(self, words: list[str]) -> np.ndarray:
        """Log joint probability (word, class)."""
        out = np.tile(self.prior, (len(words), 1))
        step = 2000
        for lo in range(0, len(words), step):
            part = [w.encode("utf-8", "replace") for w in words[lo : lo + step]]
            word, bucket = bigrams(part)
            if len(word):
                first = np.nonzero(np.concatenate([[True], word[1:] != word[:-1]]))[0]
                out[lo + word[first]] += np.add.reduceat(self.weights[bucket], first, axis=0)
        return out


@lru_cache(maxsize=1 << 18)
def core(word: str) -> str:
    """A word in small letters without what is no letter or digit at its ends."""
    w = word.lower()
    at = [i for i, c in enumerate(w) if c.isalnum()]
    return w[at[0] : at[-1] + 1] if at else w


def _count(words: Counter) -> np.ndarray:
    keys = [w.encode("utf-8", "replace") for w in words]
    if not keys:
        return np.zeros(BUCKETS)
    word, bucket = bigrams(keys)
    return np.bincount(bucket, weights=np.sqrt(np.fromiter(words.values(), float, len(keys)))[word], minlength=BUCKETS)


def train(words: Counter, rounds: int = 2) -> Classifier:
    """Counts of each class from the words, also in other letter case, and from their garbled forms;
    in a further round the words taken for garbled no longer count as right."""
    prior = np.log(np.array([1 - PRIOR, *([PRIOR / len(_CLASSES)] * len(_CLASSES))]))
    model = None
    made_of: list[dict[str, str]] = [{} for _ in _CLASSES]  # words garbled in the first round
    for _ in range(rounds):
        clean = Counter(words)
        if model is not None and clean:
            for w, v in zip(list(clean), judge_words(model, list(clean)), strict=True):
                if v:
                    del clean[w]
        cased = clean + Counter({w.upper(): 1 for w in clean}) + Counter({w.capitalize(): 1 for w in clean})
        counts = [_count(cased)]
        for chain, known in zip(_CLASSES, made_of, strict=True):
            made: Counter = Counter()
            if model is None:
                for w in cased:
                    try:
                        known[w] = garble(w, chain)
                    except UnicodeError:
                        continue
            for w, n in cased.items():
                g = known.get(w, w)
                if g != w:
                    made[g] += n
            counts.append(_count(made))
        c = np.array(counts) + _SMOOTHING
        seen: Counter = Counter()
        for w, n in clean.items():
            seen[core(w)] += n
        model = Classifier(np.ascontiguousarray(np.log(c / c.sum(axis=1, keepdims=True)).T.astype(np.float32)), prior, seen)
    return model


@dataclass(frozen=True)
class Verdict:
    """The chain of a garbled word; ``text`` is the word restored, None where bytes are lost, ``gain`` how much
    likelier it is, in nats."""

    chain: Chain
    text: str | None
    gain: float = 0.0


#: Classes whose first step wrote UTF-8, so that inverting is a proof, and the others.
_PROVEN = np.array([1 + i for i, c in enumerate(CHAINS) if c[0][0] == "utf-8"])
_LOOSE = np.array([1 + i for i, c in enumerate(CHAINS) if c[0][0] != "utf-8"])
_LOST = np.array([1 + len(CHAINS) + i for i in range(len(LOSSY))])
_ORDER = {c: i for i, c in enumerate(_CLASSES)}


def _right(model: Classifier, words: list[str]) -> np.ndarray:
    """Log probability of each as right text; texts share most of their words."""
    known = model.right
    if len(known) > 1 << 19:
        known.clear()
    new = [w for w in dict.fromkeys(words) if w not in known]
    if new:
        known.update(zip(new, (model.scores(new)[:, 0] - model.prior[0]).tolist(), strict=True))
    return np.array([known[w] for w in words])


def judge_words(model: Classifier, words: list[str], scores: np.ndarray | None = None) -> list[list[Verdict]]:
    """Words that were UTF-8 once: of the chains the classifier proposes those that invert strictly to a text likelier, by
    MARGIN, than the word as it is, the likeliest first, and words of a chain that loses bytes; none for a right word."""
    out: list[list[Verdict]] = [[] for _ in words]
    if not words:
        return out
    scores = model.scores(words) if scores is None else scores
    odds = scores[:, _PROVEN] - scores[:, :1] - (model.prior[1] - model.prior[0])
    asked: list[tuple[int, Chain, str]] = []
    for i in np.nonzero(odds.max(axis=1) > 0)[0].tolist():
        for k in np.argsort(-odds[i])[: int((odds[i] > 0).sum())]:
            chain = CHAINS[_PROVEN[k] - 1]
            try:
                t = restore(words[i], chain)
            except UnicodeError:
                continue
            if t != words[i]:
                asked.append((i, chain, t))
    before = scores[:, 0] - model.prior[0]
    after = _right(model, [t for _, _, t in asked])
    for n in np.argsort(-after, kind="stable").tolist():
        i, chain, t = asked[n]
        if after[n] - before[i] > MARGIN:
            out[i].append(Verdict(chain, t, float(after[n] - before[i])))
    for i in np.nonzero(odds.max(axis=1) > LOST_MARGIN)[0].tolist():
        chain = CHAINS[_PROVEN[int(np.argmax(odds[i]))] - 1]
        if not out[i] and recovered_share(words[i], chain) >= LOST_SHARE:
            out[i] = [Verdict(chain, None)]
    likeliest = scores.argmax(axis=1)
    sure = scores.max(axis=1) - scores[:, 0] - (model.prior[1] - model.prior[0]) > LOST_MARGIN
    for i in np.nonzero((likeliest >= _LOST[0]) & sure)[0].tolist():
        if not out[i]:
            out[i] = [Verdict(LOSSY[likeliest[i] - _LOST[0]], None)]
    return out


def _agreed(verdicts: list[list[Verdict]]) -> list[Verdict]:
    """Of each word's readings the one whose chain reads most words of the text, of equally good ones that of the
    likeliest text as a whole, then the first in CHAINS."""
    votes: Counter = Counter()
    worth: Counter = Counter()
    for readings in verdicts:
        for v in readings:
            votes[v.chain] += 1
            worth[v.chain] += v.gain
    return [max(readings, key=lambda v: (votes[v.chain], round(worth[v.chain], 3), -_ORDER[v.chain])) for readings in verdicts]


def _best_part(gain: np.ndarray) -> tuple[float, int, int]:
    """(sum, first, end) of the consecutive part with the largest sum."""
    total = np.concatenate([[0.0], np.cumsum(gain)])
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total[1:] - low[:-1])) + 1
    first = int(np.argmin(total[:end]))
    return float(total[end] - total[first]), first, end


@dataclass(frozen=True)
class Reading:
    """Words ``first`` to ``end`` of a run as another chain reads them; the classifier's log odds and the gain in likelihood."""

    first: int
    end: int
    chain: Chain
    texts: list[str]
    odds: float
    gain: float


class _Back(dict):
    """Characters as read to characters as written, of two encodings of single bytes; others become a mark."""

    def __init__(self, written: str, read: str) -> None:
        to, back = _tables(written)[0], _tables(read)[1]
        super().__init__({c: to[ord(b)] for c, b in back.items()})

    def __missing__(self, c: int) -> str:
        return "\uffff"


@lru_cache(maxsize=None)
def _back(k: int) -> _Back | None:
    ((written, read), *more) = CHAINS[k]
    return None if more or {written, read} & {"utf-8", "gbk", "big5"} else _Back(written, read)


@lru_cache(maxsize=1 << 18)
def _restored(word: str, k: int) -> str | None:
    """The word before the k-th chain, None where that can't be; texts share most of their words."""
    table = _back(k)
    if table is not None:
        text = word.translate(table)
        return None if "\uffff" in text else text
    try:
        return restore(word, CHAINS[k])
    except UnicodeError:
        return None


def run_readings(model: Classifier, words: list[str], scores: np.ndarray, pooled: bool = False) -> list[Reading]:
    """Of consecutive words the part that each mistake between other encodings explains best, if it gains RUN_MARGIN.

    ``pooled``: the words are those of a whole text; a word that the chain leaves as it is counts neither way, and one that
    can't have come from it ends the part.
    """
    odds = scores[:, _LOOSE] - scores[:, :1] - (model.prior[1] - model.prior[0])
    out = []
    for k in np.nonzero(np.maximum(odds, 0).sum(axis=0) > RUN_MARGIN)[0].tolist():
        number = int(_LOOSE[k]) - 1
        worth = odds[:, k]
        if pooled:
            worth = worth.astype(float)
            up = np.nonzero(worth > 0)[0]
            # most chains end here, before the other words are read; the best part begins and ends with one of these
            for i in up.tolist():
                back = _restored(words[i], number)
                if back is None or back == words[i]:
                    worth[i] = -1e6 if back is None else 0.0
            up = up[worth[up] > 0]
            if worth[up].sum() <= RUN_MARGIN:
                continue
            worth[: up[0]] = worth[up[-1] + 1 :] = -1e6
            for i in (up[0] + np.nonzero(worth[up[0] : up[-1]] <= 0)[0]).tolist():
                back = _restored(words[i], number)
                if back is None or back == words[i]:
                    worth[i] = -1e6 if back is None else 0.0
        total, first, end = _best_part(worth)
        if total <= RUN_MARGIN or sum(c > "\x7f" for w in words[first:end] for c in w) < RUN_CHARS:
            continue
        texts = [_restored(w, number) for w in words[first:end]]
        if None in texts:
            continue
        gain = float(_right(model, texts).sum() - (scores[first:end, 0] - model.prior[0]).sum())
        if gain > RUN_MARGIN:
            out.append(Reading(first, end, CHAINS[number], texts, total, gain))
    return out


def judge_run(readings: list[Reading], words: list[str], lost: list[bool], seen: Mapping[str, int]) -> tuple[int, int, list[Verdict]] | None:
    """The reading of a run that gains most, unless words of the corpus, ``seen`` so often, speak against it.

    Words that look like UTF-8 with ``lost`` bytes are only read otherwise if words of the corpus come out.
    """
    best = None
    for r in readings:
        if best is not None and r.odds <= best.gain - RUN_MARGIN:
            continue
        # words of the corpus speak for the reading they are frequent in
        votes = 0
        for w, t in zip(words[r.first : r.end], r.texts, strict=True):
            a, b = seen.get(core(w), 0), seen.get(core(t), 0)
            votes += (b >= OFTEN * max(a, 1)) - (a >= OFTEN * max(b, 1))
        if votes < 0 or votes == 0 and (r.gain <= UNSEEN_MARGIN or any(lost[r.first : r.end])):
            continue
        if best is None or r.gain > best.gain:
            best = r
    return best and (best.first, best.end, [Verdict(best.chain, t) for t in best.texts])


def cutter():
    """Words with characters beyond ASCII; between two words of a run stand no letters of other words."""
    return re.compile(r"(?<![^ \t\r\n])[^ \t\r\n\x80-\U0010ffff]*+[^\x00-\x7f][^ \t\r\n]*"), re.compile(r"[A-Za-z\n]")


@dataclass(frozen=True)
class Inspected:
    """Verdicts by (first, end) of the word in the text; ``asked`` are the words, by their core, whose counts they depend on."""

    spans: list[tuple[int, int, Verdict]]
    asked: frozenset[str] = frozenset()

    def restored(self, text: str) -> str:
        """The text with every restorable word put right."""
        out, at = [], 0
        for lo, hi, v in self.spans:
            out += [text[at:lo], text[lo:hi] if v.text is None else v.text]
            at = hi
        return "".join([*out, text[at:]])


#: Characters looked at together; a longer text is cut at line ends, else at blanks, and none of it is left out.
PIECE_CHARS = 200_000


def pieces(text: str) -> list[tuple[int, str]]:
    """(offset, part) of a text in parts of bounded length, cut only where no word is."""
    out, at = [], 0
    while len(text) - at > PIECE_CHARS:
        end = next((e for e in (text.rfind(c, at, at + PIECE_CHARS) for c in "\n ") if e > at), -1)
        if end < 0:  # one word longer than that
            end = next((i for i in range(at + PIECE_CHARS, len(text)) if text[i] in " \t\r\n"), len(text))
        out.append((at, text[at:end]))
        at = end
    return [*out, (at, text[at:])]


def inspect(model: Classifier, texts: Iterable[str | None], seen: Mapping[str, int] | None = None) -> list[Inspected]:
    """The garbled words of each text, whole; a null or empty text has none. ``seen`` counts words by their core, else those
    of the training do."""
    texts = list(texts)
    seen = model.seen if seen is None else seen
    parts = [(i, at, p) for i, t in enumerate(texts) if t for at, p in pieces(t)]
    out: list[list[tuple[int, int, Verdict]]] = [[] for _ in texts]
    asked: list[set[str]] = [set() for _ in texts]
    block, size = [], 0
    for part in [*parts, None]:
        if part is None or size + len(part[2]) > 4 * PIECE_CHARS:
            for (i, at, _), g in zip(block, _inspect(model, [p for _, _, p in block], seen), strict=True):
                out[i] += [(at + lo, at + hi, v) for lo, hi, v in g.spans]
                asked[i] |= g.asked
            block, size = [], 0
        if part:
            block.append(part)
            size += len(part[2])
    return [Inspected(s, frozenset(a)) for s, a in zip(out, asked, strict=True)]


def _inspect(model: Classifier, texts: list[str], seen: Mapping[str, int]) -> list[Inspected]:
    if not texts:
        return []
    word, between = cutter()
    found = [[(m.start(), m.end(), m.group()) for m in word.finditer(t)] if t else [] for t in texts]
    index = {w: i for i, w in enumerate(dict.fromkeys(w for f in found for _, _, w in f))}
    words = list(index)
    scores = model.scores(words)
    verdicts = judge_words(model, words, scores)
    # what a word can add to a run at most, over all chains
    loose = np.maximum(scores[:, _LOOSE].max(axis=1, initial=-np.inf) - scores[:, 0] - (model.prior[1] - model.prior[0]), 0).tolist() if len(words) else []
    out = []
    for t, f in zip(texts, found, strict=True):
        read = [(lo, hi, verdicts[index[w]]) for lo, hi, w in f if verdicts[index[w]]]
        spans = {lo: (lo, hi, v) for (lo, hi, _), v in zip(read, _agreed([r for _, _, r in read]), strict=True)}
        asked: set[str] = set()
        if sum(loose[index[w]] for _, _, w in f) > RUN_MARGIN:
            # a word that lost bytes of UTF-8 may turn out as one of another encoding
            free = [item for item in f if all(v.text is None and v.chain not in LOSSY for v in verdicts[index[item[2]]])]

            at = {lo for lo, _, _ in free}
            read_as: set[int] = set()

            def read_run(run: list[tuple[int, int, str]], pooled: bool, asked=asked, spans=spans, read_as=read_as) -> bool:
                rows = [index[w] for _, _, w in run]
                own = [w for _, _, w in run]
                if sum(loose[r] for r in rows) <= RUN_MARGIN:
                    return False
                readings = run_readings(model, own, scores[rows], pooled)
                asked.update(core(w) for r in readings for w in (*own[r.first : r.end], *r.texts))
                got = judge_run(readings, own, [bool(verdicts[r]) for r in rows], seen)
                if got:
                    spans |= {lo: (lo, hi, v) for (lo, hi, w), v in zip(run[got[0] : got[1]], got[2], strict=True) if not pooled or v.text != w}
                    read_as.update(lo for lo, _, _ in run[got[0] : got[1]])
                return bool(got)

            run: list[tuple[int, int, str]] = []
            for item in [*f, None]:
                if run and (item is None or between.search(t, run[-1][1], item[0])):
                    read_run(run, False)
                    run = []
                if item and item[0] in at:
                    run.append(item)
            # ASCII words, which a mistake leaves as they are, may stand between the words of a passage
            while read_run([item for item in free if item[0] not in read_as], True):
                pass
        out.append(Inspected([spans[lo] for lo in sorted(spans)], frozenset(asked)))
    return out


def training_words(documents: DataFrame, rows: int = TRAINING_ROWS, size: int = TRAINING_BYTES) -> Counter:
    """Words beyond ASCII, counted, of whole documents chosen by the hash of their text: about ``rows`` distinct ones of about ``size`` bytes
    together, none of over a hundredth of it; all that the driver sees."""
    texts = documents.where("text IS NOT NULL AND text <> ''").select("text")
    total = texts.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    share = min(1.0, rows / max(total["n"], 1), size / max(total["bytes"], 1))
    chosen = texts.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < F.lit(int((1 << 30) * share))).where(F.octet_length("text") <= size // 100).distinct()
    words = chosen.select(F.explode(F.split("text", r"[ \t\r\n]+")).alias("word")).where("word RLIKE '[^\\\\x00-\\\\x7F]'")
    return Counter({r["word"]: r["n"] for r in words.groupBy("word").agg(F.count("*").alias("n")).toLocalIterator()})


def corpus_words(documents: DataFrame, model) -> DataFrame:
    """``core, seen``: how often each word beyond ASCII occurs in all documents, by its core; words that were UTF-8 once
    don't count. ``model`` is a broadcast classifier."""
    words = documents.select(F.explode(F.split("text", r"[ \t\r\n]+")).alias("word")).where("word RLIKE '[^\\\\x00-\\\\x7F]'")

    def right(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_pylist()
            keep = np.array([not v for v in judge_words(model.value, own)], bool)
            yield pa.RecordBatch.from_arrays([pa.array([core(w) for w, k in zip(own, keep, strict=True) if k], pa.string()), batch.column(1).filter(pa.array(keep))], names=["core", "n"])

    once = words.groupBy("word").agg(F.count("*").alias("n"))
    return once.mapInArrow(right, "core string, n long").groupBy("core").agg(F.sum("n").alias("seen"))


def find_garbled(documents: DataFrame, training_rows: int = TRAINING_ROWS) -> DataFrame:
    """``doc_id, restored, words, lost, chains``: documents with garbled words, by the classifier.

    ``restored`` is the text with every invertible word put right, ``words`` how many are garbled,
    ``lost`` how many of them can't be had back, ``chains`` the mistakes as ``written>read``. Null, empty and
    plain ASCII texts never appear; a row delivered twice appears twice. Only the classifier rests on a sample: texts
    whose verdict depends on words of the corpus are judged by their counts in all documents.
    """
    spark = documents.sparkSession
    model = spark.sparkContext.broadcast(replace(train(training_words(documents, training_rows)), seen=Counter(), right={}))
    names = ["doc_id", "restored", "words", "lost", "chains"]
    schema = "doc_id long, restored string, words int, lost int, chains array<string>"

    def columns(rows: list[tuple[int, str, Inspected]]) -> list[pa.Array]:
        return [
            pa.array([i for i, _, _ in rows], pa.int64()),
            pa.array([g.restored(t) for _, t, g in rows], pa.string()),
            pa.array([len(g.spans) for _, _, g in rows], pa.int32()),
            pa.array([sum(v.text is None for _, _, v in g.spans) for _, _, g in rows], pa.int32()),
            pa.array([sorted({", ".join(f"{a}>{b}" for a, b in v.chain) for _, _, v in g.spans}) for _, _, g in rows], pa.list_(pa.string())),
        ]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                texts = part.column(1).to_pylist()
                rows = [(i, t, g) for i, t, g in zip(part.column(0).to_pylist(), texts, inspect(model.value, texts), strict=True) if g.spans or g.asked]
                open_ = [t if g.asked else None for _, t, g in rows]
                yield pa.RecordBatch.from_arrays([*columns(rows), pa.array(open_, pa.string()), pa.array([sorted(g.asked) for _, _, g in rows], pa.list_(pa.string()))], names=[*names, "text", "asked"])

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                texts = part.column(1).to_pylist()
                seen = {w: n for m in part.column(2).to_pylist() for w, n in m or ()}
                yield pa.RecordBatch.from_arrays(columns([(i, t, g) for i, t, g in zip(part.column(0).to_pylist(), texts, inspect(model.value, texts, seen), strict=True) if g.spans]), names=names)

    beyond_ascii = documents.where("text RLIKE '[^\\\\x00-\\\\x7F]'").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    looked_at = materialise(beyond_ascii.mapInArrow(first, f"{schema}, text string, asked array<string>"), "garbled")
    open_texts = looked_at.where("text IS NOT NULL").select("doc_id", "text", "asked", F.sha2("text", 256).alias("key"))
    asked = open_texts.select("key", F.explode("asked").alias("core")).distinct()
    counts = salted_join(asked, corpus_words(documents, model), ["core"], "key").groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("core", "seen"))).alias("seen"))
    decided = open_texts.join(counts, "key", "left").select("doc_id", "text", "seen").mapInArrow(second, schema)
    return looked_at.where("text IS NULL").select(*names).unionByName(decided)
