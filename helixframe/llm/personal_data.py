"""Personal data: fixed patterns, and a linear-chain conditional random field over word-shape features.

The patterns find e-mail addresses, IP addresses, card numbers and telephone numbers.  They run in time
linear in the text: an address is looked for around each @, and digit runs are entered at their start alone.

The field labels white-space-parted words as O, secret, email, phone, ip or card (labelled_table() makes its
training sentences by rule).  A word's features depend on the word alone and enter for it, for the word before
and the word after, so that words with equal features share three rows of scores; a task remembers each
distinct word's row number.  Viterbi runs in numpy over batches: where no run of other labels that holds a word could
make up O's lead by its words and moves, the best path has O there, so only the runs between such words are decoded,
all those of one length together.

The labelled table mixes secrets of several unlike makes (assigned values, prefixed keys, capitals with digits, pass
phrases, dotted tokens, key headers) with what only looks like them, and with public identifiers: commits, sums, UUIDs,
addresses of network cards and hosts, of web pages and files.  A bare number in hexadecimal digits is a secret where a word
announces one.  The words of a key header are one span.  Features are classes of a word, so that makes that
the table lacks are found too; of a shape its first 12 marks are one feature, and more than 20 digits count as 20.

Spans of the field are added where no pattern's span overlaps; the patterns' spans stay.

Defined results: a null text counts as empty and has no spans; long texts are searched whole, many short ones together;
a path that ties with another of the field goes by the order of LABELS; rows that repeat a doc_id each come out; an
empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import in_small_batches, table

BASE = ("email", "ip", "card", "phone")
LABELS = ("O", "secret", "email", "phone", "ip", "card")
ORDER = {kind: i for i, kind in enumerate((*BASE, "secret"))}
#: Words a task remembers; then it starts anew.
MOST_WORDS = 200_000
SENTENCES, SEED, STEPS, STEP, PRIOR = 800, 11, 150, 0.1, 0.01

Span = tuple[str, int, int]

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NUMBERS = str.maketrans("", "", " -+().")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local@domain: a match begins with the run of local characters before an @."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and LOCAL.match(text[start - 1]):
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            last = domain.end()
            yield start, last
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[Span]:
    found: list[Span] = [("email", *x) for x in emails(text)]
    if "." in text:
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                found.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().translate(NUMBERS)
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(m.group().translate(NUMBERS)) <= 15:
                found.append(("phone", m.start(), m.end()))
    return found


# The field's features -------------------------------------------------------------------------------

DIGITS, LOWER, UPPER = re.compile(r"[0-9]+"), re.compile(r"[^\W\d_A-Z]+"), re.compile(r"[A-ZÀ-ÖØ-Þ]+")
EDGES = "\"'.,;:!?()[]{}<>#$%&*|"
#: Identifiers that are public as a rule: of objects, network cards and hosts; places in the web and in file systems.
PUBLIC = (
    ("uuid", re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")),
    ("host", re.compile(r"[0-9A-Fa-f]{2}([:-][0-9A-Fa-f]{2}){5}|(?=.*:.*:)[0-9A-Fa-f]{0,4}(:[0-9A-Fa-f]{0,4}){2,7}")),
    ("url", re.compile(r"[A-Za-z][A-Za-z+.-]*://.*|www\..*")),
    ("path", re.compile(r"(?=.*/.*/)[\w.~/+@=-]+")),
    ("sum", re.compile(r"(sha(1|256|512)|md5)[:-][0-9A-Fa-f]{32,128}")),
)
#: Words that announce a secret or a way to reach somebody.
CUES = {x: "secret" for x in "token secret password passwd pwd apikey api_key key auth bearer".split()} | {x: "reach" for x in "phone tel call mobile fax email mail contact".split()}


def shape(word: str) -> str:
    return UPPER.sub("A", LOWER.sub("a", DIGITS.sub("9", word)))


def word_features(word: str) -> tuple[str, ...]:
    core = word.strip(EDGES)
    s = shape(core)
    digits = sum(c.isdigit() for c in core)
    plain = s in ("a", "A", "Aa", "")
    mixed = bool(digits) and core.isalnum() and not core.isdigit()
    found = ["plain" if plain else f"shape={s[:12]}", f"digits={min(digits, 20)}" if digits else "no-digit"]
    found.append(f"cue={CUES.get(core.lower().rstrip('='), '-')}")
    found += [f"public={name}" for name, pattern in PUBLIC if len(core) >= 8 and pattern.fullmatch(core)]
    found.append(f"long={'no' if len(core) < 16 else 'yes' if len(core) < 24 else 'very'}")
    if mixed:
        found.append(f"mixed-{'long' if len(core) >= 20 else 'short'}{'-hex' if re.fullmatch(r'[0-9a-fA-F]+', core) else ''}")
    if digits and not core.isdigit():
        # How often the word goes from one kind of character to another: keys do so all along, words and dates rarely.
        letters = s.replace("_", "").replace("-", "")
        found.append(f"changes={'few' if len(letters) < 5 else 'some' if len(letters) < 9 else 'many'}")
        if ("_" in core or "-" in core) and any(c.isalpha() for c in core):
            found.append(f"joined={'short' if len(core) < 12 else 'long'}")
    if core.count(".") == 2 and len(core) >= 24:
        found.append("dotted")
    if core[:5] == "-----" or core[-5:] == "-----":
        found.append("header")
    if re.split("[=:]", core, maxsplit=1)[0].lower() in CUES and re.search("[=:].", core):
        found.append("assigned")
    if word == "=" or word.endswith((":", "=")):
        found.append("assigns")
    if "@" in core:
        found.append("at")
    if core.count(".") == 3 and core.replace(".", "").isdigit():
        found.append("quad")
    if word[:1] == "+" and digits:
        found.append("plus")
    if word[:1] in "\"'" and word[-1:] in "\"'":
        found.append("quoted")
    return tuple(found)


def labelled_table(sentences: int = SENTENCES, seed: int = SEED) -> list[tuple[list[str], list[str]]]:
    """The small labelled table: sentences of made-up words, some with personal data or what looks like it."""
    rng = random.Random(seed)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    mixed = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n))
    syllables = "an be co da en fi ge ha in jo ka lo mi ne or pa qu re so te un vi wh za".split()

    def word() -> str:
        made = "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
        made = rng.choice((made, made, made, made.capitalize(), made.upper()))
        return made + rng.choice(("", "", "", "", ",", ".", "###", "$$$", "%%%", "!!", "***", "&&&"))

    def item() -> list[tuple[str, str]]:
        end = rng.choice(("", "", ".", ",", "###", "!!", "%%%"))
        kind = rng.choice((*range(24), 20, 20))
        if kind == 15:  # a prefixed key, with or without a word that announces it
            body = mixed(rng.randint(18, 40))
            prefix = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 5)))
            value = [(prefix + rng.choice("_-") + rng.choice(("", "", "test_", "prod-")) + body + end, "secret")]
            return value if rng.random() < 0.6 else [(rng.choice(("token", "key", "auth")), "O"), *value]
        if kind == 16:
            return [("".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(4)) + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(rng.randint(12, 20))) + end, "secret")]
        if kind == 17:  # a pass phrase after its word
            part = lambda: word().strip(EDGES).lower()
            value = rng.choice((f"{part()}{digits(1)}-{part()}-{part()}", f"{part().capitalize()}{digits(2)}!{part()}", f"{part()}_{digits(4)}", f"{part()}{digits(3)}{part().upper()}"))
            return [(rng.choice(("password", "passwd", "pwd", "Password:", "password:")), "O"), *([("is", "O")] if rng.random() < 0.2 else []), (value + end, "secret")]
        if kind == 18:
            return [(f"ey{mixed(rng.randint(16, 30))}.{mixed(rng.randint(20, 50))}.{mixed(rng.randint(24, 43))}{end}", "secret")]
        if kind == 19:
            return [(x, "secret") for x in rng.choice((("-----BEGIN", "PRIVATE", "KEY-----"), ("-----BEGIN", rng.choice(("EC", "DSA")), "PRIVATE", "KEY-----")))]
        if kind == 20:  # what only looks like a key
            part = lambda: word().strip(EDGES).lower()
            return [(rng.choice((f"{part()}-{part()}", f"{part()}_{part()}_{digits(4)}", f"{part()}-{part()}-{digits(1)}", f"v{digits(1)}-{part()}{digits(1)}", f"{digits(4)}-{digits(2)}-{digits(2)}T{digits(2)}:{digits(2)}", part().upper() + part().upper(), f"{part()}.{part()}.{part()}", f"{part()}{digits(2)}", "-----", part().upper() + digits(4), f"{part()}_{digits(4)}_{part()}.pdf", f"https://www.{part()}.example.org/{part()}/{part()[:1]}-{digits(3)}/{part()}.html", f"{digits(3)}-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}", f"{digits(4)}-{digits(2)}-{digits(2)}T{digits(2)}:{digits(2)}:{digits(2)}Z", f"{part()}/{part()}-{digits(2)}.{part()}", f"{part()}{digits(1)}{part()[:1]}")) + end, "O")]
        if kind in (21, 22, 23):  # identifiers, places and sums
            part = lambda: word().strip(EDGES).lower()
            uuid = "-".join(hexes(n) for n in (8, 4, 4, 4, 12))
            value = rng.choice((
                *[hexes(rng.choice((32, 40, 64)))] * 4, *[uuid, uuid.upper()] * 2, ":".join(hexes(2) for _ in range(6)), "-".join(hexes(2) for _ in range(6)).upper(), ":".join(hexes(4) for _ in range(8)), f"fe80::{hexes(4)}:{hexes(4)}", f"2001:db8::{hexes(3)}",
                f"https://{part()}.example.org/{part()}/{hexes(rng.choice((8, 12, 40)))}", f"https://{part()}.example.com/{part()}-{part()}-{digits(rng.randint(2, 9))}?id={digits(6)}&x={mixed(8)}", f"/usr/{part()}/{part()}-{digits(1)}.{digits(2)}/{part()}{digits(2)}.so",
                f"{part()}/{part()}{digits(1)}/{part()}-{digits(3)}", f"sha256:{hexes(64)}", f"doi:{digits(2)}.{digits(4)}/{part()}.{digits(5)}", hexes(rng.randint(7, 12)), f"www.{part()}{digits(2)}.example.org/{part()}",
            ))
            cue = rng.choice(("commit", "id", "sha256", "object", "revision", "at", "see", "md5:", "checksum:", "uuid:", "host", word()))
            return [(cue, "O"), (value + end, "O")]
        if kind < 4:
            quote = rng.choice(('"', '"', "'", ""))
            value = quote + rng.choice((hexes(rng.choice((20, 32, 40, 64))), "".join(rng.choice("abcdefGHIJKLmnop0123456789") for _ in range(rng.randint(24, 44))))) + quote + end
            cue = rng.choice(("token", "secret", "password", "api_key", "key", "TOKEN"))
            if rng.random() < 0.25:  # all in one word
                return [(f"{cue}{rng.choice('==:')}{rng.choice((hexes(rng.randint(12, 40)), mixed(rng.randint(14, 40))))}{end}", "secret")]
            return [(x, "O") for x in rng.choice(((cue, "="), (f"{cue}:",), (f"{cue}=",)))] + [(value, "secret")]
        if kind == 4:
            return [(f"{word().strip(EDGES).lower()}.{digits(2)}@mail{digits(1)}.example.com{end}", "email")]
        if kind == 5:
            return [(f"+{digits(1)}", "phone"), (f"({digits(3)})", "phone"), (f"{digits(3)}-{digits(4)}{end}", "phone")]
        if kind == 6:
            return [(".".join(str(rng.randint(0, 255)) for _ in range(4)) + end, "ip")]
        if kind == 7:
            return [(digits(16) + end, "card")]
        if kind == 8:  # what only looks like it
            return [(rng.choice((digits(4), digits(2), f"{digits(1)}.{digits(1)}", f"{digits(1)}.{digits(2)}.{digits(1)}", f"{digits(3)}-{digits(2)}", f"{digits(4)}-{digits(2)}", f"{digits(2)}-{digits(2)}", f"v{digits(1)}.{digits(1)}")) + end, "O")]
        if kind == 9:
            return [("key", "O"), (word(), "O"), ("=", "O"), (word(), "O")]
        if kind == 10:
            return [(f"{word().strip(EDGES)}{digits(1)}", "O"), (digits(rng.randint(5, 8)), "O")]
        if kind == 11:
            return [("".join(word().strip(EDGES) for _ in range(5)) + end, "O")]
        if kind == 12:
            return [("token", "O"), (word(), "O")]
        if kind == 13:
            return [(f"https://{word().strip(EDGES).lower()}.example.org/{digits(4)}", "O")]
        return [(word(), "O"), (f"({digits(1)})", "O"), (f"{digits(4)}-{digits(2)}-{digits(2)}", "O")]

    rows = []
    for _ in range(sentences):
        pairs = [(word(), "O") for _ in range(rng.randint(1, 6))]
        for _ in range(rng.randint(0, 2)):
            pairs += item() + [(word(), "O") for _ in range(rng.randint(0, 4))]
        rows.append(([w for w, _ in pairs], [label for _, label in pairs]))
    return rows


@dataclass
class Field:
    """Scores by feature for a word itself, as the word before, as the word after; and of label pairs."""

    index: dict[str, int]
    own: np.ndarray
    before: np.ndarray
    after: np.ndarray
    moves: np.ndarray

    def rows(self, word: str) -> np.ndarray:
        at = [self.index[x] for x in word_features(word) if x in self.index]
        return np.stack([w[at].sum(axis=0) for w in (self.own, self.before, self.after)])


def _forward_backward(emit: np.ndarray, moves: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label and label-pair expectations of padded sentences (sentence, word, label)."""
    n, length, labels = emit.shape
    logsum = lambda x, axis: (m := x.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis=axis))
    a, b = np.zeros_like(emit), np.zeros_like(emit)
    a[:, 0] = emit[:, 0]
    for t in range(1, length):
        step = logsum(a[:, t - 1, :, None] + moves, 1) + emit[:, t]
        a[:, t] = np.where(mask[:, t, None], step, a[:, t - 1])
    for t in range(length - 2, -1, -1):
        step = logsum(moves + (emit[:, t + 1] + b[:, t + 1])[:, None, :], 2)
        b[:, t] = np.where(mask[:, t + 1, None], step, 0)
    z = logsum(a[:, -1], 1)
    single = np.exp(a + b - z[:, None, None]) * mask[:, :, None]
    pairs = np.zeros((labels, labels))
    for t in range(1, length):
        p = np.exp(a[:, t - 1, :, None] + moves + (emit[:, t] + b[:, t])[:, None, :] - z[:, None, None])
        pairs += (p * mask[:, t, None, None]).sum(axis=0)
    return single, pairs


def train(rows: list[tuple[list[str], list[str]]]) -> Field:
    """Maximum likelihood with a Gaussian prior, by Adam steps on the exact gradient."""
    # Words with equal features are one row of `known`; the last row, of no features, stands beyond a sentence's ends.
    kinds = sorted({word_features(w) for words, _ in rows for w in words})
    number = {k: i for i, k in enumerate(kinds)}
    names = sorted({f for k in kinds for f in k})
    index = {f: i for i, f in enumerate(names)}
    n, length, width, none = len(rows), max(len(w) for w, _ in rows), len(names), len(kinds)
    known = np.zeros((none + 1, width))
    for i, k in enumerate(kinds):
        known[i, [index[f] for f in k]] = 1
    at = np.full((n, length + 2), none)
    gold, mask = np.zeros((n, length, len(LABELS))), np.zeros((n, length), bool)
    for i, (words, labels) in enumerate(rows):
        for t, (word, label) in enumerate(zip(words, labels, strict=True)):
            at[i, t + 1] = number[word_features(word)]
            gold[i, t, LABELS.index(label)], mask[i, t] = 1, True
    views = [at[:, 1:-1], at[:, :-2], at[:, 2:]]  # the word, the one before, the one after
    gold_pairs = np.einsum("ntk,ntl->kl", gold[:, :-1], gold[:, 1:])
    theta = np.zeros((3 * width + len(LABELS), len(LABELS)))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        parts = theta[: 3 * width].reshape(3, width, -1)
        emit = sum((known @ p)[x] for p, x in zip(parts, views, strict=True)) * mask[:, :, None]
        single, pairs = _forward_backward(emit, theta[3 * width :], mask)
        off = (gold - single) * mask[:, :, None]
        by_kind = [np.stack([np.bincount(x.ravel(), off[:, :, k].ravel(), none + 1) for k in range(len(LABELS))], axis=1) for x in views]
        g = np.concatenate([*(known.T @ x for x in by_kind), gold_pairs - pairs]) / n - PRIOR * theta / 10
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta += STEP * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field(index, theta[:width], theta[width : 2 * width], theta[2 * width : 3 * width], theta[3 * width :])


@lru_cache(1)
def field() -> Field:
    """The field trained on the labelled table; the same wherever it is trained."""
    return train(labelled_table())


def viterbi(emit: np.ndarray, moves: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Best labels (run, word) of runs of one length: emit (run, word, label); first: scores of entering, last: of leaving."""
    runs, length, _ = emit.shape
    score, back = emit[:, 0] + first, np.zeros(emit.shape, np.int8)
    for t in range(1, length):
        all_ = score[:, :, None] + moves
        back[:, t] = all_.argmax(axis=1)
        score = all_.max(axis=1) + emit[:, t]
    best = np.zeros((runs, length), np.int8)
    best[:, -1] = (score + last).argmax(axis=1)
    for t in range(length - 1, 0, -1):
        best[:, t - 1] = back[np.arange(runs), t, best[:, t]]
    return best


class Decoder:
    """Labels the words of many texts at once."""

    def __init__(self, found: Field):
        self.field = found
        self.moves = found.moves
        # What a run of other labels can gain over O's by its moves: at its ends, and for each step inside.
        here = found.moves[0, 0]
        self.ends = max(0.0, (found.moves[0, 1:] - here).max()) + max(0.0, (found.moves[1:, 0] - here).max())
        self.step = (found.moves[1:, 1:] - here).max()
        self.known: dict[str, int] = {}
        self.by_features: dict[tuple[str, ...], int] = {}
        self.scores: list[np.ndarray] = []

    def number(self, word: str) -> int:
        key = word_features(word)
        at = self.by_features.get(key)
        if at is None:
            at = self.by_features[key] = len(self.scores)
            self.scores.append(self.field.rows(word))
        self.known[word] = at
        return at

    def unsure(self, emit: np.ndarray) -> np.ndarray:
        """The words that may have another label than O: those in a run whose words and moves together may beat O's."""
        sums = np.concatenate([[0], np.cumsum(emit[:, 1:].max(axis=1) - emit[:, 0] + self.step)])
        # The best run that holds a word begins where the sum before it is least and ends where it is greatest.
        best = np.maximum.accumulate(sums[:0:-1])[::-1] - np.minimum.accumulate(sums[:-1])
        return best >= self.step - self.ends - 1e-6

    def labels(self, texts: list[list[str]]) -> dict[int, list[tuple[int, int]]]:
        """text number -> (word number, label) of its words that aren't O."""
        if len(self.known) > MOST_WORDS:
            self.known.clear()
        if len(self.by_features) > MOST_WORDS:
            self.known.clear(), self.by_features.clear(), self.scores.clear()
        known, number = self.known, self.number
        at = np.array([i for words in texts for i in [known[w] if w in known else number(w) for w in words]], np.int64)
        if not len(at):
            return {}
        bounds = np.concatenate([[0], np.cumsum([len(w) for w in texts])])
        starts, ends = np.zeros(len(at), bool), np.zeros(len(at), bool)
        sizes = np.diff(bounds)
        starts[bounds[:-1][sizes > 0]], ends[bounds[1:][sizes > 0] - 1] = True, True
        rows = np.stack(self.scores)
        emit = rows[at, 0]
        emit[1:] += np.where(starts[1:, None], 0, rows[at[:-1], 1])
        emit[:-1] += np.where(ends[:-1, None], 0, rows[at[1:], 2])
        unsure = self.unsure(emit)
        where = np.flatnonzero(unsure)
        if not len(where):
            return {}
        new = np.ones(len(where), bool)
        new[1:] = (np.diff(where) > 1) | starts[where[1:]]
        heads = np.flatnonzero(new)
        lengths = np.diff(np.append(heads, len(where)))
        heads = where[heads]
        out: dict[int, list[tuple[int, int]]] = {}
        for length in np.unique(lengths):
            run = heads[lengths == length]
            first = np.where(starts[run, None], 0, self.moves[0])
            last = np.where(ends[run + length - 1, None], 0, self.moves[:, 0])
            best = viterbi(emit[run[:, None] + np.arange(length)], self.moves, first, last)
            for i, j in zip(*np.nonzero(best), strict=True):
                word = int(run[i] + j)
                text = int(np.searchsorted(bounds, word, "right") - 1)
                out.setdefault(text, []).append((word - int(bounds[text]), int(best[i, j])))
        return out


PLACES = re.compile(r"\S+")


def field_spans(text: str, labels: list[tuple[int, int]]) -> list[Span]:
    """Spans of labelled words: neighbours of one label make one span, without the marks at its edges."""
    wanted, found, before = dict(sorted(labels)), [], None
    for i, m in enumerate(PLACES.finditer(text)):
        label = wanted.get(i)
        if label:
            core = m.group().strip(EDGES)
            start = m.start() + (m.group().find(core) if core else 0)
            end = start + len(core or m.group())
            header = found and text.startswith("-----", found[-1][1]) and not text.endswith("-----", found[-1][1] + 5, found[-1][2])
            if before == (i - 1, label) and (LABELS[label] == "phone" or LABELS[label] == "secret" and header):
                found[-1] = (found[-1][0], found[-1][1], end)
            else:
                found.append((LABELS[label], start, end))
            before = (i, label)
    return found


def merged(base: list[Span], more: list[Span]) -> list[Span]:
    """base, and what of more overlaps none of it, by kind and start."""
    taken = sorted((s, e) for _, s, e in base)
    starts = np.array([s for s, _ in taken])
    reach = np.maximum.accumulate([e for _, e in taken]) if taken else starts

    def free(x: Span) -> bool:
        before = int(np.searchsorted(starts, x[2], "left"))
        return not before or reach[before - 1] <= x[1]

    return sorted(base + [x for x in more if free(x)], key=lambda x: (ORDER[x[0]], x[1], x[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


#: Words that are labelled at once.
TOGETHER = 200_000


def found_in(texts: Iterator[str], decoder: Decoder) -> Iterator[tuple[list[Span], list[Span]]]:
    """The patterns' spans and all spans of each text, in order."""

    def flush(held: list[tuple[str, list[str]]]) -> Iterator[tuple[list[Span], list[Span]]]:
        labels = decoder.labels([words for _, words in held])
        for i, (text, _) in enumerate(held):
            base = sorted(base_spans(text), key=lambda x: (ORDER[x[0]], x[1]))
            yield base, merged(base, field_spans(text, labels[i])) if i in labels else base

    held, n = [], 0
    for text in texts:
        held.append((text, text.split()))
        n += len(held[-1][1])
        if n >= TOGETHER:
            yield from flush(held)
            held, n = [], 0
    yield from flush(held)


def _find(made: Field) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(made)
        for batch in batches:
            rows = []
            for base, spans in found_in((x.as_py() or "" for x in batch.column(1)), decoder):
                counts = [sum(x[0] == kind for x in base) for kind in BASE]
                rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return run


def spans(documents: DataFrame) -> DataFrame:
    """doc_id, counts and digest of the patterns' spans, and all spans of each row."""
    rows = in_small_batches(documents).select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return rows.mapInArrow(_find(field()), "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")


def masked_text(text: str, found: list[Span]) -> str:
    """The text with each span as [KIND]; spans that overlap become one, of the first's kind."""
    out, at = [], 0
    for kind, start, end in sorted(found, key=lambda x: (x[1], -x[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def masked(documents: DataFrame) -> DataFrame:
    """documents, all columns, with personal data in text replaced; a null text stays null."""
    at, made = documents.columns.index("text"), field()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(made)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            done = [None if t is None else masked_text(t, found) for t, (_, found) in zip(texts, found_in((t or "" for t in texts), decoder), strict=True)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(done, batch.schema.field(at).type))

    return in_small_batches(documents).mapInArrow(run, documents.schema)


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(table(spark, sf_dir, "documents"))
