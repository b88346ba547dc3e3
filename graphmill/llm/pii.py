"""Personal data: patterns with checks, and a linear-chain CRF over word shapes for what patterns miss."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache as once

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphmill.llm.common import map_rows

#: The kinds in their order, and their patterns.
KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A match begins where its digits do, so a long run of digits is read once.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: What a word holds that can be part of personal data; words without it, two words off any that has it, are label O.
SIGN = re.compile(r"[0-9@]|[\[({<](?:at|dot)[\])}>]", re.IGNORECASE)
DIGIT = re.compile(r"[0-9]")
REACH = 2
#: A secret without the name before it and the quotes around it.
BARE = re.compile(r"([^\s=:\"'`]+)[\"'`)\]},;.]*\Z")
#: Characters of a shape that is kept whole; cells, words times labels, that are decoded at a time.
LONG, CELLS = 64, 1 << 18
#: Found by the CRF alone, after the others in order: passwords, tokens and keys.
SECRET = "secret"
ORDERED = (*KINDS, SECRET)
LABELS = ("O", *(f"{p}-{k}" for k in ORDERED for p in "BI"))

Span = tuple[str, int, int]


def digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """EMAIL's leftmost matches, found from their @ so that long words cost no rescans."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := EMAIL.match(text, start)):
            last = m.end()
            yield start, last
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[Span]:
    """Pattern matches that pass their checks, by start, then kind."""
    found: list[Span] = [("email", *x) for x in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        found += [("ip", *m.span()) for m in IP.finditer(text) if all(int(part[-4:]) <= 255 and not part[:-4].strip("0") for part in m[0].split("."))]
        found += [("card", *m.span()) for m in CARD.finditer(text) if 12 <= len(d := digits(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            found += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def shape(word: str) -> str:
    """Digits as 9, letters as a or A, runs over three shortened; @ and brackets around at and dot stay. A long shape is
    its beginning, all its characters, and its end."""
    if m := re.fullmatch(r"[\[({<](at|dot)[\])}>]", word, re.IGNORECASE):
        return f"[{m[1].lower()}]"
    s = re.sub(r"[a-zß-ÿ]", "a", re.sub(r"[A-ZÀ-Þ]", "A", re.sub(r"[0-9]", "9", word.rstrip(".,;:!?") or word)))
    s = re.sub(r"(.)\1{3,}", r"\1\1\1\1", s)
    return s if len(s) <= LONG else f"{s[: LONG // 3]}~{''.join(sorted(set(s)))}~{s[-LONG // 3 :]}"


def features(words: list[str], begin: int = 0, end: int | None = None) -> list[list[str]]:
    """The features of words[begin:end]."""
    end = len(words) if end is None else min(end, len(words))
    shapes = [shape(words[begin - 1]) if begin else "^", *map(shape, words[begin:end]), shape(words[end]) if end < len(words) else "$"]
    out = []
    for i, word in enumerate(words[begin:end], 1):
        n = len(digits(word))
        turns = len(re.findall(r"[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])", word))
        out.append(["bias", f"l={min(len(word) // 4, 10)}", f"t={min(turns, 6)}", f"lt={len(word) > 13}{turns > 2}{word.isupper()}", f"s={shapes[i]}", f"p={shapes[i - 1]}", f"n={shapes[i + 1]}", f"ps={shapes[i - 1]}|{shapes[i]}", f"sn={shapes[i]}|{shapes[i + 1]}", f"d={min(n, 20)}", "c=" + re.sub(r"(.)\1+", r"\1", shapes[i]), f"m={''.join(sorted(set(re.sub('[0-9A-Za-z]', '', word))))[:6]}", f"w={word.lower()}" if len(word) < 6 and not n else "w=-"])
    return out


#: The labelled table: a pattern of words, of which those between {kind and } are that kind. 9 is any digit, § any digit of
#: base 16, ¤ any capital or digit, and what follows § or ¤ in a number of times is drawn as often.
LABELLED = (
    "call {phone (999) 999-9999 } or write", "phone {phone 999-999-9999 } today", "the {phone 999.999.9999 } and", "tel {phone (99) 9999 9999 } is", "fax: {phone 999 999 9999 } until",
    "ring {phone (999)999-9999 } at once", "is {phone 999-9999-9999 } here", "mail {email aaaa [at] aaaaa [dot] com } now", "to {email aa.aaaa (at) aaaa.com } or", "write {email aaaa [at] aaaa [dot] aa [dot] org } if",
    "of {email aaaaa <at> aaaaaa.net } and", "host {ip 99[.]999[.]9[.]99 } was", "from {ip 999[.]99[.]99[.]999 } came", "the {ip 9[.]99[.]999[.]9 } is", "card {card 9999.9999.9999.9999 } in",
    "pay {card 9999_9999_9999_9999 } of", "with {card 9999/9999/9999/9999 } an", "in 9999 the aaaa", "on 9999-99-99 it was", "at 99:99 of that", "about 9,999 aaaa of", "version 9.9.9 of the", "pages 999-999 of", "for 99.99 in all",
    'token = {secret "§40" } from', 'key = {secret "§32" } with', "password={secret_ §18 } of", "is {secret AKIA¤16 } and", "the {secret AKIA¤16 } in", "secret: {secret §24 } that", "key {secret sk-§32 } was", "aaaa {secret AKIA¤16 } aaaa", "password={secret_ §12 } the",
    "of §6 in the", "the ¤5 and more", "AA9999 was the", "aaaa9 and aaaa99 of", "AAAA-9999 in a", "aaaaaaaaaaaaaaaaaaaaaa99 of the", "99aaaa and 99AA of", "the 999 aaaa and 99 more", "the (99) of them", "the aaaa [9] and [99] of", "in 99/99/9999 and after", "a 9999999999999999 in the", "at 99.999.99.999 of", "a9a9-99aa-99aa-9999 in",
    "id 9999999 was a", "the 9999999999 of it", "number 999999999999 is", "aaaa@aaaa and more", "https://aaaa.com/9999/99 in the", "chapter 9 of 99 and", "sum 999,999,999.99 for", "9999 9999 and 9999 of", "the aaaa (aaaa) of", "+9 (999) 999-9999 the",
)


def labelled_table(copies: int = 16, seed: int = 7) -> list[tuple[list[str], list[int]]]:
    """Sentences and their labels: LABELLED with digits and letters filled in, `copies` times; half of the plain words
    around personal data are replaced by invented ones."""
    draw, out = np.random.default_rng(seed), []
    letter = lambda: chr(97 + draw.integers(26))
    fill = lambda: "".join(letter() for _ in range(draw.integers(2, 8)))
    drawn = lambda m: "".join(draw.choice(list("0123456789abcdef" if m[1] == "§" else "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), int(m[2])))
    for sentence in LABELLED * copies:
        words, labels, kind, begun = [], [], None, False
        sentence = re.sub(r"(\S+=)\{secret_ (\S+)", r"{secret \1\2", sentence)
        for part in sentence.split():
            if part[0] == "{" and part[1:] in ORDERED:
                kind, begun = part[1:], False
            elif part == "}":
                kind = None
            else:
                plain = re.fullmatch(r"[a-z]+:?|\[(at|dot)\]|\((at|dot)\)|<at>|com", part) and not re.fullmatch(r"a+", part)
                words.append(part if plain else re.sub(r"([§¤])([0-9]+)", drawn, part) if "§" in part or "¤" in part else re.sub(r"9", lambda _: str(draw.integers(10)), re.sub(r"a+", lambda m: "".join(letter() for _ in range(len(m[0]) if DIGIT.search(part) else draw.integers(3, 9))), part)))
                labels.append(LABELS.index(f"{'I' if begun else 'B'}-{kind}") if kind else 0)
                begun = True
        words = [fill() if not y and w.isalpha() and draw.random() < 0.5 else w for w, y in zip(words, labels, strict=True)]
        before, after = [fill() for _ in range(draw.integers(0, 3))], [fill() for _ in range(draw.integers(0, 3))]
        out.append((before + words + after, [0] * len(before) + labels + [0] * len(after)))
    return out


def logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


@dataclass
class Crf:
    names: dict[str, int]
    emit: np.ndarray  # features x labels
    move: np.ndarray  # label to label

    def scores(self, sentences: list[list[list[str]]]) -> np.ndarray:
        """Emission scores of features, padded to the longest sentence."""
        out = np.zeros((len(sentences), max(map(len, sentences)), len(LABELS)))
        for i, s in enumerate(sentences):
            for j, names in enumerate(s):
                out[i, j] = self.emit[[k for n in names if (k := self.names.get(n)) is not None]].sum(axis=0)
        return out

    def decode(self, sentences: list[list[str]]) -> list[list[int]]:
        """The best labels of each sentence. Sentences of like length are decoded together, so that padding is less than
        what they hold, and within CELLS."""
        order = sorted(range(len(sentences)), key=lambda i: len(sentences[i]))
        out: list[list[int]] = [[] for _ in sentences]
        while order:
            n, shortest = 1, len(sentences[order[0]])
            while n < len(order) and (size := len(sentences[order[n]])) <= 2 * shortest + 8 and (n + 1) * size * len(LABELS) <= CELLS:
                n += 1
            part, order = order[:n], order[n:]
            for i, labels in zip(part, self.viterbi([sentences[i] for i in part]), strict=True):
                out[i] = labels
        return out

    def viterbi(self, sentences: list[list[str]]) -> list[list[int]]:
        """Viterbi over a batch of sentences at once, a block of words at a time: the state at a block's end carries over,
        and only a byte a cell stays for the way back."""
        lengths = np.array([len(s) for s in sentences])
        steps = int(lengths.max(initial=0))
        if not steps:
            return [[] for _ in sentences]
        back = np.zeros((len(sentences), steps, len(LABELS)), np.uint8)
        paths, best = np.arange(len(LABELS), dtype=np.uint8), np.zeros((len(sentences), len(LABELS)))
        block = max(1, CELLS // (len(sentences) * len(LABELS)))
        for begin in range(0, steps, block):
            score = self.scores([features(s, begin, begin + block) if begin < len(s) else [] for s in sentences])
            for t in range(begin, min(begin + score.shape[1], steps)):
                if not t:
                    best = score[:, 0].copy()
                    continue
                through = best[:, :, None] + self.move[None]
                inside = (t < lengths)[:, None]
                back[:, t] = np.where(inside, through.argmax(axis=1), paths)
                best = np.where(inside, through.max(axis=1) + score[:, t - begin], best)
        at = best.argmax(axis=1)
        out = np.zeros((len(sentences), steps), np.uint8)
        for t in range(steps - 1, -1, -1):
            out[:, t] = at
            at = back[np.arange(len(at)), t, at]
        return [row[:n].tolist() for row, n in zip(out, lengths, strict=True)]


@once
def trained(rounds: int = 100, rate: float = 0.2, decay: float = 1e-4) -> Crf:
    """The CRF of the highest penalised conditional likelihood of labelled_table(), by Adam on exact gradients from
    the forward-backward recursion."""
    table = labelled_table()
    names: dict[str, int] = {}
    feats = [[[names.setdefault(n, len(names)) for n in f] for f in features(words)] for words, _ in table]
    size, steps, k = len(table), max(len(w) for w, _ in table), len(LABELS)
    index = np.full((size, steps, max(len(f) for s in feats for f in s)), len(names))
    gold, lengths = np.zeros((size, steps), int), np.array([len(w) for w, _ in table])
    for i, s in enumerate(feats):
        gold[i, : len(s)] = table[i][1]
        for j, f in enumerate(s):
            index[i, j, : len(f)] = f
    inside = np.arange(steps)[None] < lengths[:, None]
    pairs = inside[:, 1:]
    # Words by feature, so that a feature's gradient is one run of rows.
    index = index[inside]
    order = np.argsort(index, axis=None, kind="stable")
    used, begin = np.unique(index.ravel()[order], return_index=True)
    word = order // index.shape[1]
    weights = [np.zeros((len(names) + 1, k)), np.zeros((k, k))]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for n in range(1, rounds + 1):
        emit, move = weights
        score = np.zeros((size, steps, k))
        score[inside] = emit[index].sum(axis=1)
        ahead, behind = np.zeros_like(score), np.zeros_like(score)
        ahead[:, 0] = score[:, 0]
        for t in range(1, steps):
            ahead[:, t] = np.where(inside[:, t, None], logsumexp(ahead[:, t - 1, :, None] + move, 1) + score[:, t], ahead[:, t - 1])
        for t in range(steps - 2, -1, -1):
            behind[:, t] = np.where(inside[:, t + 1, None], logsumexp(move[None] + (score[:, t + 1] + behind[:, t + 1])[:, None], 2), 0)
        total = logsumexp(ahead[:, -1], 1)
        belief = np.exp(ahead + behind - total[:, None, None]) * inside[..., None]
        both = np.exp(ahead[:, :-1, :, None] + move + (score[:, 1:] + behind[:, 1:])[:, :, None] - total[:, None, None, None]) * pairs[..., None, None]
        miss = np.eye(k)[gold] * inside[..., None] - belief
        grads = [np.zeros_like(emit), -both.sum(axis=(0, 1)) / size]
        grads[0][used] = np.add.reduceat(miss[inside][word] / size, begin, axis=0)
        np.add.at(grads[1], (gold[:, :-1][pairs], gold[:, 1:][pairs]), 1 / size)
        for w, g, a, b in zip(weights, grads, first, second, strict=True):
            g -= decay * w
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            w += rate * (a / (1 - 0.9**n)) / (np.sqrt(b / (1 - 0.99**n)) + 1e-8)
        weights[0][-1] = 0
    return Crf(names, weights[0][:-1], weights[1])


def plausible(kind: str, said: str) -> bool:
    """Whether a decoded span passes its kind's check digits and ranges; how it is written is the CRF's to judge."""
    number = digits(said)
    if kind == "ip":
        parts = re.findall(r"[0-9]+", said)
        return len(parts) == 4 and all(len(p) < 4 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 12 <= len(number) <= 19 and luhn(number)
    if kind == SECRET:
        return len(said) >= 12 and bool(number) and len(number) < len(said)
    return 9 <= len(number) <= 15 if kind == "phone" else True


def windows(text: str) -> Iterator[list[tuple[int, int]]]:
    """Runs of words, by begin and end, within REACH of a word that has a SIGN; none if no word has."""
    run: list[tuple[int, int]] = []
    last: list[tuple[int, int]] = []
    follow = -1
    for m in WORD.finditer(text):
        if SIGN.search(m[0]):
            run += [*last, m.span()]
            last, follow = [], REACH
        elif run and follow > 0:
            run.append(m.span())
            follow -= 1
        else:
            last = [*last, m.span()]
            if run and len(last) > REACH:
                yield run
                run = []
            last = last[-REACH:] if not run else last
    if run:
        yield run


def crf_spans(crf: Crf, text: str, runs: list[list[tuple[int, int]]]) -> list[Span]:
    """What the CRF finds in the runs of a text, trimmed of punctuation at its end."""
    found: list[Span] = []
    for run, labels in zip(runs, crf.decode([[text[a:b] for a, b in run] for run in runs]), strict=True):
        i = 0
        while i < len(run):
            if labels[i]:
                kind = LABELS[labels[i]][2:]
                j = i + 1
                while j < len(run) and LABELS[labels[j]] == f"I-{kind}":
                    j += 1
                start = run[i][0]
                said = text[start : run[j - 1][1]].rstrip(".,;:!?")
                if kind == SECRET and (m := BARE.search(said)):
                    start, said = start + m.start(1), m[1]
                if said and plausible(kind, said):
                    found.append((kind, start, start + len(said)))
                i = j
            else:
                i += 1
    return found


def find_spans(crf: Crf, text: str) -> tuple[list[Span], list[Span]]:
    """(base, added); added ones never overlap base ones."""
    if not SIGN.search(text):
        return [], []
    base = base_spans(text)
    runs = [r for r in windows(text)]
    taken = np.array(sorted(b[1:] for b in base)).reshape(-1, 2)
    ends = np.maximum.accumulate(taken[:, 1]) if len(taken) else taken[:, 1]
    free = lambda s: not (n := int(np.searchsorted(taken[:, 0], s[2]))) or ends[n - 1] <= s[1]
    return base, [s for s in crf_spans(crf, text, runs) if free(s)] if runs else []


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans array<struct<kind, start, end, base>>) for every row of docs, spans in code points by start, then
    kind as in ORDERED; base tells pattern matches from what the CRF adds, secrets among it.

    Whole texts are searched. The CRF decodes every word within two words of one that has a digit, an @ or a
    bracketed at or dot; no other word can belong to what it was trained on. What it adds must pass its kind's check
    digits and ranges and must not overlap a pattern match. Null and empty texts have no spans. Repeated rows and null ids give rows of
    their own. An empty table gives an empty result. Other columns are ignored.
    """
    crf = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            out = []
            for cell in batch.column("text"):
                base, added = find_spans(crf, cell.as_py() or "")
                both = sorted([(s, True) for s in base] + [(s, False) for s in added], key=lambda x: (x[0][1], ORDERED.index(x[0][0])))
                out.append([{"kind": k, "start": a, "end": b, "base": own} for (k, a, b), own in both])
            yield {"id": batch.column("id"), "spans": out}

    return map_rows(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), "id long, spans array<struct<kind: string, start: long, end: long, base: boolean>>", run).withColumnRenamed("id", id_col)


def masked(text: Column) -> Column:
    """The text with each span, or each run of overlapping spans, replaced by its first kind in brackets."""
    crf = trained()

    def one(t: str) -> str:
        base, added = find_spans(crf, t)
        out, at, end = [], 0, -1
        for kind, a, b in sorted(base + added, key=lambda s: (s[1], ORDERED.index(s[0]))):
            if a < end:
                end = max(end, b)
                continue
            if end >= 0:
                at = end
            out += [t[at:a], f"[{kind.upper()}]"]
            end = b
        return "".join([*out, t[max(end, 0) :]]) if out else t

    @F.arrow_udf("string")
    def mask(texts: pa.Array) -> pa.Array:
        parts = [pa.array([one(x) if x else x for x in texts.slice(at, 512).to_pylist()], pa.string()) for at in range(0, len(texts), 512)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return mask(text)
