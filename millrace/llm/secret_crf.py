"""Secret scans: base patterns, and a linear-chain conditional random field decoded by Viterbi."""

from __future__ import annotations

import hashlib
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.encoding import in_chunks

# Kinds in the order they are listed, their patterns, groups and least lengths.
KINDS = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 16),
]
#: Runs of hexadecimal digits are whole either way, so the least length can be part of this one pattern.
_LONG_HEX = re.compile(r"[0-9a-f]{16,}")
OUTSIDE, BEGIN, INSIDE = 0, 1, 2
#: Score of a transition that makes no sense: inside after outside.
NEVER = -12.0

RESULT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_assign", T.LongType()),
                       T.StructField("n_access", T.LongType()), T.StructField("n_hex", T.LongType()),
                       T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()),
                       T.StructField("n_crf", T.LongType())])


def base_spans(text: str) -> list[tuple[int, int, str, int]]:
    """(start, rank of the kind, kind, end) of all base matches, sorted; matches that fail are dropped."""
    found = []
    for rank, (kind, pattern, group, least) in enumerate(KINDS):
        if kind == "assign" and "=" not in text and ":" not in text:
            continue
        for match in (_LONG_HEX if kind == "hex" else pattern).finditer(text):
            if match.end(group) - match.start(group) >= least:
                found.append((match.start(), rank, kind, match.end()))
    return sorted(found)


#: Features of a word's shape; each is one weight per tag.
SHAPE = ["always", "keyword", "ends in = or :", "only = or :", "holds = or :", "quoted", "prefix of a key", "has @",
         "has /", "8 to 15 long", "16 to 31 long", "32 long or more", "digits and letters", "half digits", "upper and lower",
         "only upper and digits", "only hexadecimal", "key characters only", "has a dot", "many changes of class", "not ASCII",
         "holds :", "letters only", "digits, upper and lower", "hexadecimal digits and letters, 10 or more",
         "upper and digits, 12 or more", "six changes of class, 12 or more long", "joined by - or _", "a long word of the three classes", "no letters",
         "digits joined by dots"]
_KEYWORD = re.compile(rb"password|passwd|pwd|secret|token|api_?key|credential|private|bearer|auth", re.I)
_PREFIX = re.compile(rb"AKIA|ASIA|sk-|pk-|sk_|ghp_|gho_|github_pat_|xox[abp]-|eyJ|AIza|-----BEGIN")


def _marked(*groups: bytes) -> np.ndarray:
    """A table of 256 entries that is True for the bytes of the groups."""
    table = np.zeros(256, dtype=bool)
    table[list(b"".join(groups))] = True
    return table


_DIGITS, _LOWER, _UPPER = b"0123456789", bytes(range(97, 123)), bytes(range(65, 91))
_SPACE = _marked(b" \t\n\r\x0b\x0c")
#: A class of each byte, whose changes are counted: digits, lower, upper, others.
_CLASS = (_marked(_DIGITS) + 2 * _marked(_LOWER) + 3 * _marked(_UPPER)).astype(np.uint8)
_TABLES = {"digit": _marked(_DIGITS), "lower": _marked(_LOWER), "upper": _marked(_UPPER), "assign": _marked(b"=:"), "at": _marked(b"@"),
           "slash": _marked(b"/"), "dot": _marked(b"."), "hex": _marked(_DIGITS, b"abcdef"),
           "key": _marked(_DIGITS, _LOWER, _UPPER, b"+/_.=:\"',-"), "wide": _marked(bytes(range(128, 256))),
           "colon": _marked(b":"), "join": _marked(b"-_")}


def shapes(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, end, features) of every word, from running counts over the bytes."""
    raw = np.frombuffer(text, dtype=np.uint8)
    edge = np.diff(_SPACE[raw].astype(np.int8), prepend=np.int8(1), append=np.int8(1))
    first, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    size = end - first
    out = np.zeros((len(first), len(SHAPE)), dtype=np.float32)
    if not len(first):
        return first, end, out

    def counted(marks: np.ndarray) -> np.ndarray:
        running = np.concatenate([[0], np.cumsum(marks, dtype=np.int32)])
        return running[end] - running[first]

    n = {name: counted(table[raw]) for name, table in _TABLES.items()}
    kinds = _CLASS[raw]
    turns = np.concatenate([[False], (kinds[1:] != kinds[:-1]) & (kinds[1:] > 0) & (kinds[:-1] > 0)])
    turns[first] = False
    head, tail = raw[first], raw[end - 1]
    quote, assign = _marked(b"\"'"), _TABLES["assign"]
    letters = n["lower"] + n["upper"]
    inner = n["assign"] - assign[tail]
    n_turns, mixed = counted(turns), (n["digit"] > 0) & (n["upper"] > 0) & (n["lower"] > 0)
    values = {
        "always": np.ones(len(first), dtype=bool), "ends in = or :": assign[tail], "only = or :": (size == 1) & assign[head],
        "holds = or :": inner > 0, "quoted": quote[head] | quote[tail], "has @": n["at"] > 0, "has /": n["slash"] > 0,
        "8 to 15 long": (size >= 8) & (size < 16), "16 to 31 long": (size >= 16) & (size < 32), "32 long or more": size >= 32,
        "digits and letters": (n["digit"] > 0) & (letters > 0), "half digits": 2 * n["digit"] >= size,
        "upper and lower": (n["lower"] > 0) & (n["upper"] > 0),
        "only upper and digits": (n["upper"] > 0) & (n["upper"] + n["digit"] == size),
        "only hexadecimal": (n["hex"] >= 8) & (n["hex"] == letters + n["digit"]), "key characters only": n["key"] == size,
        "has a dot": n["dot"] > 0, "many changes of class": n_turns >= 4, "not ASCII": n["wide"] > 0,
        "holds :": n["colon"] - (tail == ord(":")) > 0, "letters only": letters == size, "digits, upper and lower": mixed,
        "hexadecimal digits and letters, 10 or more": (n["hex"] >= 10) & (n["hex"] == letters + n["digit"]) & (n["digit"] > 0) & (letters > 0),
        "upper and digits, 12 or more": (n["upper"] + n["digit"] >= 12) & (n["lower"] == 0) & (n["upper"] > 0) & (n["digit"] > 0),
        "six changes of class, 12 or more long": (n_turns >= 6) & (size >= 12), "joined by - or _": n["join"] > 0,
        "a long word of the three classes": mixed & (n["key"] == size) & (size >= 12), "no letters": letters + n["wide"] == 0,
        "digits joined by dots": (letters + n["wide"] == 0) & (n["dot"] > 0) & (n["digit"] > 0)}
    for name, value in values.items():
        out[:, SHAPE.index(name)] = value
    for name, pattern in (("keyword", _KEYWORD), ("prefix of a key", _PREFIX)):
        hits = [match.start() for match in pattern.finditer(text)]
        out[np.searchsorted(first, hits, side="right") - 1, SHAPE.index(name)] = 1
    return first, end, out


def file_features(words: int, lang: str | None, text_size: int) -> np.ndarray:
    """Features of the document a word stands in."""
    return np.array([words < 100, words >= 2000, text_size > 8 * max(1, words), (lang or "") == ""], dtype=np.float64)


@dataclass
class Field:
    """Weights of the field: of the word itself, of the words before and after it, of the file, of transitions."""

    own: np.ndarray
    before: np.ndarray
    after: np.ndarray
    file: np.ndarray
    moves: np.ndarray

    @classmethod
    def zeros(cls) -> Field:
        wide = (len(SHAPE), 3)
        return cls(np.zeros(wide), np.zeros(wide), np.zeros(wide), np.zeros((4, 3)), np.zeros((3, 3)))

    def parts(self) -> list[np.ndarray]:
        return [self.own, self.before, self.after, self.file, self.moves]

    def transitions(self) -> np.ndarray:
        moves = self.moves.copy()
        moves[OUTSIDE, INSIDE] = NEVER
        return moves


def train(shapes: np.ndarray, files: np.ndarray, tags: np.ndarray, steps: int = 150, rate: float = 0.1,
          ridge: float = 1e-3) -> Field:
    """Fit the field to windows of words (windows, words, features) by gradient ascent with adaptive steps."""
    field = Field.zeros()
    count, length = tags.shape
    truth = np.eye(3)[tags]
    pairs = np.einsum("nta,ntb->ab", truth[:, :-1], truth[:, 1:])
    flat = np.ascontiguousarray(shapes.reshape(count * length, -1), dtype=np.float32)
    mean, square = [np.zeros_like(p) for p in field.parts()], [np.zeros_like(p) for p in field.parts()]
    for step in range(1, steps + 1):
        # One product scores each word for itself, for the word after it and for the word before it.
        table = (flat @ np.concatenate([field.own, field.before, field.after], axis=1).astype(np.float32)).reshape(count, length, 9).astype(float)
        scores, moves = table[..., :3] + (files @ field.file)[:, None, :], field.transitions()
        scores[:, 1:] += table[:, :-1, 3:6]
        scores[:, :-1] += table[:, 1:, 6:]
        # Forward and backward sums over the tags, scaled to a sum of 1 at each word.
        here, move = np.exp(scores - scores.max(axis=2, keepdims=True)), np.exp(moves)
        forward, backward = np.empty_like(here), np.ones_like(here)
        forward[:, 0] = here[:, 0]
        for t in range(1, length):
            ahead = (forward[:, t - 1] @ move) * here[:, t]
            forward[:, t] = ahead / ahead.sum(axis=1, keepdims=True)
        for t in range(length - 2, -1, -1):
            behind = (here[:, t + 1] * backward[:, t + 1]) @ move.T
            backward[:, t] = behind / behind.sum(axis=1, keepdims=True)
        shares = forward * backward
        gap = truth - shares / shares.sum(axis=2, keepdims=True)
        left, right = forward[:, :-1].reshape(-1, 3), (here[:, 1:] * backward[:, 1:]).reshape(-1, 3)
        joint = move * (left.T @ (right / ((left @ move) * right).sum(axis=1, keepdims=True)))
        wide = np.zeros((count, length, 9), dtype=np.float32)
        wide[..., :3], wide[:, :-1, 3:6], wide[:, 1:, 6:] = gap, gap[:, 1:], gap[:, :-1]
        slope = (flat.T @ wide.reshape(count * length, 9)).astype(float)
        slopes = [slope[:, :3], slope[:, 3:6], slope[:, 6:], files.T @ gap.sum(axis=1), pairs - joint]
        for i, (part, slope) in enumerate(zip(field.parts(), slopes)):
            slope = slope / count - ridge * part
            mean[i] = 0.9 * mean[i] + 0.1 * slope
            square[i] = 0.999 * square[i] + 0.001 * slope ** 2
            part += rate * (mean[i] / (1 - 0.9 ** step)) / (np.sqrt(square[i] / (1 - 0.999 ** step)) + 1e-8)
    return field


def viterbi(scores: np.ndarray, moves: np.ndarray) -> list[int]:
    """The best tags of words that stand between words outside."""
    best, back = scores[0] + moves[OUTSIDE], []
    for row in scores[1:]:
        ways = best[:, None] + moves
        back.append(ways.argmax(axis=0))
        best = ways.max(axis=0) + row
    tag = int((best + moves[:, OUTSIDE]).argmax())
    tags = [tag]
    for came in reversed(back):
        tag = int(came[tag])
        tags.append(tag)
    return tags[::-1]


class Decoder:
    """Decodes whole documents, many at a time."""

    def __init__(self, field: Field):
        self.field = field
        self.weights = np.concatenate([field.own, field.before, field.after], axis=1).astype(np.float32)
        # Every word has one move to it and one from it, so a part of a move that depends on one end only
        # can count as the word's score. What is left in the moves has a small range.
        self.moves, self.shift = field.transitions(), np.zeros(3)
        allowed = np.ones((3, 3), dtype=bool)
        allowed[OUTSIDE, INSIDE] = False
        for _ in range(50):
            for axis in (0, 1):
                high = np.where(allowed, self.moves, -np.inf).max(axis=axis)
                low = np.where(allowed, self.moves, np.inf).min(axis=axis)
                self.shift += (high + low) / 2
                self.moves -= np.expand_dims((high + low) / 2, axis)
        used = self.moves[allowed]
        self.lead = 2 * (used.max() - used.min())

    def _open(self, scores: np.ndarray) -> np.ndarray:
        """Words that may be in a secret. A word is surely outside if its score outside leads by more than two moves can
        make good, and by more than the word after it would lose if it had to begin a secret instead of being inside."""
        lead = scores[:, OUTSIDE] - scores[:, 1:].max(axis=1)
        lead[:-1] -= np.maximum(0, scores[1:, INSIDE] - scores[1:, BEGIN])
        return np.flatnonzero(lead <= self.lead)

    def spans(self, texts: list[bytes], langs: list[str | None]) -> list[list[tuple[int, int]]]:
        """Byte spans of the secrets in each of some whole texts."""
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        begins = np.cumsum([0, *(len(text) + 1 for text in texts)])
        first, end, features = shapes(b" ".join(texts))
        if not len(first):
            return out
        owner = np.searchsorted(begins, first, side="right") - 1
        counts = np.bincount(owner, minlength=len(texts))
        facts = np.stack([file_features(int(n), lang, len(text)) for n, lang, text in zip(counts, langs, texts)])
        table = features @ self.weights
        scores = table[:, :3].astype(np.float64) + (facts @ self.field.file)[owner]
        beside = owner[1:] == owner[:-1]
        scores[1:][beside] += table[:-1, 3:6][beside]
        scores[:-1][beside] += table[1:, 6:9][beside]
        scores += self.shift
        unsure = self._open(scores)
        if len(unsure):
            apart = (np.diff(unsure) > 1) | (np.diff(owner[unsure]) > 0)
            for part in np.split(unsure, np.flatnonzero(apart) + 1):
                for low, high in _secrets(viterbi(scores[part[0]:part[-1] + 1], self.moves)):
                    document = int(owner[part[0]])
                    out[document].append((int(first[part[0] + low] - begins[document]), int(end[part[0] + high] - begins[document])))
        return out


def _secrets(tags: list[int]) -> list[tuple[int, int]]:
    """(first, last) of each begin with the insides after it."""
    out, begin = [], None
    for at, tag in enumerate([*tags, OUTSIDE]):
        if begin is not None and tag != INSIDE:
            out.append((begin, at - 1))
            begin = None
        if tag != OUTSIDE and begin is None:
            begin = at
    return out


_ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
#: What may stand before a secret that no mark gives away; the last word is the nearest.
_LEADS = ["password", "passwd", "Password is", "secret", "the secret key", "token", "Token is", "api key", "api_key is", "apikey",
          "access key", "credential", "bearer", "auth token", "private key"]
_OPENINGS = ["sk-", "pk-", "sk_", "ghp_", "gho_", "xoxb-", "AIza"]
_TERMS = ["password", "token", "secret", "api key", "keyword", "access", "bearer", "the token", "a password"]


def _drawn(rng: np.random.Generator, letters: str, low: int, high: int) -> str:
    return "".join(letters[i] for i in rng.integers(0, len(letters), rng.integers(low, high + 1)))


def _hidden_secret(rng: np.random.Generator) -> tuple[list[str], str]:
    """(words before, secret): a secret as one word, without the separators or lengths the base patterns ask for."""
    lead = _LEADS[rng.integers(len(_LEADS))].split()
    kind = rng.integers(6)
    if kind == 0:
        word = _drawn(rng, _ALNUM, 3, 10) + "-"[:rng.integers(2)] + _drawn(rng, _ALNUM, 6, 16) + str(rng.integers(10)) + "aZ"
    elif kind == 1:
        opening = _OPENINGS[rng.integers(len(_OPENINGS))] if rng.integers(2) else _drawn(rng, _ALNUM[26:52], 2, 6) + "-_"[rng.integers(2)]
        word = opening + _drawn(rng, _ALNUM + "_", 16, 40)
    elif kind == 2:
        word = ".".join(_drawn(rng, _ALNUM + "_-", *size) for size in ((12, 36), (16, 60), (16, 43)))
    elif kind == 3:
        word = ("AKIA" if rng.integers(2) else _drawn(rng, _ALNUM[:26], 4, 4)) + _drawn(rng, _ALNUM[:26] + _ALNUM[52:], 9, 13) + "7"
    elif kind == 4:
        word = _drawn(rng, "0123456789abcdef", 8, 13) + "b4"
    else:
        word = _drawn(rng, _ALNUM + "+/", 16, 44) + "="[:rng.integers(2)]
    if kind in (1, 2, 3) and rng.integers(3) == 0:
        lead = []
    quote = ["", "", "", '"', "'"][rng.integers(5)]
    return lead, quote + word + quote + ["", "", "", ".", ","][rng.integers(5)]


def _innocent(rng: np.random.Generator, plain: str) -> list[str]:
    """Words that look a little like a secret and are none: addresses, dates, numbers, names, mentions of the keywords."""
    small = _ALNUM[26:52]
    year, month, day, hour = rng.integers(1990, 2030), rng.integers(1, 13), rng.integers(1, 29), rng.integers(0, 24)
    kind, junk = rng.integers(12), ["", "", ".", ",", "&&&", "###", ")", "%"][rng.integers(8)]
    if kind == 0:
        return [f"{_drawn(rng, small, 3, 10)}.{rng.integers(100)}@{_drawn(rng, small, 3, 9)}{rng.integers(10)}.example.com{junk}"]
    if kind == 1:
        return [f"https://{_drawn(rng, small, 4, 12)}.org/{_drawn(rng, small, 3, 12)}/{_drawn(rng, small, 2, 9)}-{rng.integers(10**6)}.html{junk}"]
    if kind == 2:
        return [f"{year}-{month:02}-{day:02}T{hour:02}:{rng.integers(60):02}:00Z" if rng.integers(2) else f"{year}-{month:02}-{day:02}"]
    if kind == 3:
        return [f"+{rng.integers(1, 99)}-{rng.integers(100, 999)}-{rng.integers(100, 999)}-{rng.integers(1000, 9999)}{junk}"]
    if kind == 4:
        numbers = ".".join(str(n) for n in rng.integers(0, 256, rng.integers(2, 5)))
        return [numbers + junk if rng.integers(2) else f"v{numbers}-beta{rng.integers(9)}"]
    if kind == 5:
        return [_drawn(rng, "0123456789", 1, 13) + junk]
    if kind == 6:
        name = _drawn(rng, small, 1, 7) + _drawn(rng, small, 3, 9).capitalize()
        tail = ["", str(rng.integers(3000)), f"{rng.integers(100)}{_drawn(rng, small, 0, 4).capitalize()}"][rng.integers(3)]
        return [(name.capitalize() if rng.integers(2) else name) + tail + junk]
    if kind == 7:
        return [_drawn(rng, _ALNUM[:26], 2, 4) + "-"[:rng.integers(2)] + _drawn(rng, "0123456789", 2, 6) + junk]
    if kind == 8:
        return [f"{_drawn(rng, small, 3, 8)}_{_drawn(rng, small, 3, 9)}_{rng.integers(100)}.py"]
    if kind == 9:
        return [_drawn(rng, small, 8, 30)] if rng.integers(2) else [_drawn(rng, _ALNUM[:26], 5, 20)]
    return [*_TERMS[rng.integers(len(_TERMS))].split(), *["is"][:rng.integers(2)], plain]


def training_windows(texts: list[tuple[str, str | None]], around: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of words and their tags.

    Windows about base matches are tagged by them, and those elsewhere are outside. The same passages stand
    in again with the patterns' own marks hidden: the match gives way to a drawn secret that no base pattern
    finds (no separator before it, or too short), after a keyword or alone, so that shape and neighbours
    carry the tag. Plain passages take such secrets too, and look-alikes that are none, which are tagged
    outside. Draws depend on the text only.
    """
    views, files, tags = [], [], []
    width = 2 * around + 4
    for text, lang in texts:
        body = text.encode("utf-8", "replace")
        starts, ends, features = shapes(body)
        if len(starts) < width:
            continue
        rng = np.random.default_rng(zlib.crc32(body))
        marks = np.zeros(len(starts), dtype=np.int64)
        matches = []
        for start, _, _, end in base_spans(text):
            low, high = (len(text[:at].encode("utf-8", "replace")) for at in (start, end))
            first, last = int(np.searchsorted(starts, low, side="right")) - 1, int(np.searchsorted(starts, high, side="left")) - 1
            if marks[first:last + 1].any():
                continue
            marks[first], marks[first + 1:last + 1] = BEGIN, INSIDE
            matches.append((first, last))
        plain = [(len(starts) * (i + 1)) // (len(matches) + 3) for i in range(len(matches) + 2)]
        facts = file_features(len(starts), lang, len(body))

        def add(rows: np.ndarray, tagged: np.ndarray, centre: int) -> None:
            low = max(0, min(centre - around, len(rows) - width))
            views.append(rows[low:low + width])
            files.append(facts)
            tags.append(tagged[low:low + width])

        def stand_in(first: int, last: int, words: list[str], secret: bool) -> None:
            """The passage about the words ``first`` to ``last``, with others in their place."""
            left, right = max(0, first - width), min(len(starts), last + 1 + width)
            new = [word.encode() for word in words]
            begin = [body[starts[i]:ends[i]] for i in range(left, first)]
            after = [body[starts[i]:ends[i]] for i in range(last + 1, right)]
            at = first - left + len(new) - 1
            tagged = np.concatenate([marks[left:first], np.zeros(len(new), dtype=np.int64), marks[last + 1:right]])
            tagged[at] = BEGIN if secret else OUTSIDE
            add(shapes(b" ".join(begin + new + after))[2], tagged, at)

        for first, last in matches:
            add(features, marks, first)
            lead, word = _hidden_secret(rng)
            stand_in(first, last, [*lead, word], True)
        for centre in plain:
            add(features, marks, centre)
            if not marks[centre]:
                word = body[starts[centre]:ends[centre]].decode("utf-8", "replace")
                for _ in range(2):
                    stand_in(centre, centre, _innocent(rng, word), False)
                lead, secret = _hidden_secret(rng)
                stand_in(centre, centre, [*lead, secret], True)
    return np.array(views, dtype=np.float32), np.array(files), np.array(tags)


def fit(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", lang_column: str | None = "lang",
        sample: int = 1500, most_chars: int = 20_000) -> Field:
    """Train the field on a bounded sample of documents, up to half of which hold a base match: on these, and on
    secrets and look-alikes that ``training_windows`` draws into the same passages.

    The sample is at most ``sample`` documents of the smallest hashes, among those of up to ``most_chars``
    characters; only training leaves longer ones out. Documents are drawn by hash before their texts are
    looked at: first about 16 times ``sample``, then, until either half is full or all documents have been
    looked at, 16 times as many a round. Rare secrets are so found at any size, and at most ``sample`` rows
    reach the driver. Without texts of 16 words all weights are zero but that nothing is a secret.
    """
    text = F.col(text_column)
    lang = F.col(lang_column) if lang_column else F.lit(None).cast("string")
    hashed = docs.select(text.alias("text"), lang.alias("lang"), F.xxhash64(F.col(id_column)).alias("h")).where(F.length("text") <= most_chars)
    total = max(1, docs.count())
    marked = F.col("text").rlike(r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]|AKIA[A-Z0-9]{14}|[0-9a-f]{16}")
    rows = []
    for part, drawn in ((marked, 16 * sample), (~marked, sample)):
        low, high, wanted = 0, -(-1_000_000 * drawn // total), sample // 2
        while wanted and low < 1_000_000:
            place = F.pmod("h", F.lit(1_000_000))
            some = hashed.where((place >= low) & (place < high)).where(part)
            found = some.orderBy("h", "text").limit(wanted).collect()
            rows += [(r["text"], r["lang"]) for r in found]
            low, high, wanted = high, 16 * high, wanted - len(found)
    views, files, tags = training_windows(rows)
    if not len(views):
        field = Field.zeros()
        field.own[0, OUTSIDE] = 1000.0
        return field
    return train(views, files, tags)


def find_secrets(docs: DataFrame, field: Field | None = None, *, id_column: str = "doc_id", text_column: str = "text",
                 lang_column: str | None = "lang") -> DataFrame:
    """All secrets in every whole text: base matches, and spans that the field adds where no base match is.

    The field tags words as begin, inside or outside of a secret from their own shape, their neighbours'
    and facts of the document. Decoding is exact: words whose score outside cannot be made good by any
    transitions are outside, and Viterbi runs over the words between them.

    Returns one row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_crf. spans is
    kind:start:end by start, then kind, in code points with the end exclusive; the field's kind is ``crf``.
    A null or empty text has none; rows without an id or with a repeated one are scanned like others; an
    empty table gives no rows; a missing language counts as unknown; other columns are not read.
    """
    field = field or fit(docs, id_column=id_column, text_column=text_column, lang_column=lang_column)
    kinds = [kind for kind, *_ in KINDS]

    def scan(batches):
        decoder = Decoder(field)
        for batch in batches:
            counts, digests, spans, added = [], [], [], []
            langs = batch.column(2).to_pylist()
            for begin, chunk in in_chunks(batch.column(1).to_pylist(), 1 << 19):
                found = decoder.spans(chunk, langs[begin:begin + len(chunk)])
                for body, extra in zip(chunk, found):
                    text = body.decode("utf-8", "replace")
                    base = base_spans(text)
                    if extra and not text.isascii():
                        extra = [tuple(len(body[:at].decode("utf-8", "replace")) for at in span) for span in extra]
                    more = [(start, len(kinds), "crf", end) for start, end in extra
                            if not any(start < b[3] and b[0] < end for b in base)]
                    counts.append([sum(b[2] == kind for b in base) for kind in kinds])
                    digests.append(hashlib.sha256(_listed(base).encode()).hexdigest())
                    spans.append(_listed(sorted(base + more)))
                    added.append(len(more))
            each = zip(*counts) if counts else [[]] * len(kinds)
            yield pa.record_batch([batch.column(0), *[pa.array(c, pa.int64()) for c in each], pa.array(digests, pa.string()),
                                   pa.array(spans, pa.string()), pa.array(added, pa.int64())], names=RESULT.names)

    lang = F.col(lang_column).cast("string") if lang_column else F.lit(None).cast("string")
    return docs.select(F.col(id_column).cast("bigint"), F.coalesce(F.col(text_column), F.lit("")).cast("binary"), lang).mapInArrow(scan, RESULT)


def _listed(spans: list[tuple[int, int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in spans)
