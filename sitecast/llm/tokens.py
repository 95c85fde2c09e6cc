"""Token ids of whole texts, encoded inside Spark tasks with a public byte-level BPE."""

from collections.abc import Iterator, Sequence
from itertools import accumulate, chain
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END_ID = 2
# Words kept per worker, in two generations; they set the speed, never the ids. A third of a
# corpus' words can be rare, but half a million of the frequent ones are over 95 % of its text.
KEPT_WORDS, KEPT_LENGTH = 500_000, 64
# Bytes of text encoded at a time.
RUN_BYTES = 1 << 21
SPACE, LINE, POINT, COMMA = b" ", b"\n", b".", b","
# Below it (Latin) all versions of Unicode have the same letters.
SCRIPT_END = "ƀ"
ID = attrgetter("id")


def byte_letters() -> str:
    """The letter that stands for each byte in a byte-level vocabulary: a printable byte for itself,
    the others for the letters from 256 on, in order."""
    out, spare = [], 256
    for byte in range(256):
        itself = 0x21 <= byte <= 0x7E or 0xA1 <= byte <= 0xFF and byte != 0xAD
        out.append(chr(byte if itself else spare))
        spare += not itself
    return "".join(out)


LETTERS = byte_letters()


def spelt(word: bytes) -> str:
    """A word in the letters of the vocabulary."""
    if word.isascii():
        return LETTERS[0x20] + word[1:].decode() if word[0] == 0x20 else word.decode()
    return word.decode("latin-1").translate(LETTERS)


def word_starts(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin in the bytes of texts, and the line ends that cannot be cut out.

    A word begins with its text, with the space before it, or after a line end. A line end is a
    word, and so are a point and a comma before a space, a line end or the end of the text. A
    line end before a space, a line end or the end of the text may share a token with it.
    """
    begins = np.zeros(len(raw) + 1, bool)
    begins[offsets] = True
    line = raw == 0x0A
    first = line | (raw == 0x20)
    before_gap = begins[1:].copy()
    before_gap[:-1] |= first[1:]
    stuck = np.flatnonzero(line & before_gap)
    first |= ((raw == 0x2E) | (raw == 0x2C)) & before_gap
    first[1:] |= line[:-1]
    first |= begins[:-1]
    return np.flatnonzero(first), stuck


class WordEncoder:
    """Encodes texts word by word and remembers frequent words.

    In the vocabulary's pattern a space belongs to the word after it, and letters or digits
    never share a token with a point, a comma or a line end beside them. So a text can be cut
    there and its words encoded one by one. Texts with other runs of white space or of marks
    are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # A text that holds the string of an added token has its id there, so it is not cut.
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids are kept in 16 bits")
        # A space alone is the beginning of a longer run of white space or the end of a text.
        self.fixed = {SPACE: None} | {w: self._ids(w.decode()) for w in (LINE, POINT, COMMA)}
        self.known: dict[bytes, bytes | None] = dict(self.fixed)
        self.older: dict[bytes, bytes | None] = {}
        self.odd = {POINT, COMMA}  # known words that end in a mark

    def _ids(self, text: str) -> bytes:
        # The batch form gives the same ids and keeps no offsets, which take a third of the time.
        ids = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return np.array(ids, dtype="<u2").tobytes()

    def _learn(self, new: list[bytes]) -> None:
        """Ids of new words; None for words that hold white space.

        Runs of letters are single words to the pattern, so they go to the vocabulary's merges
        at once. The rest is encoded as the lines of one text: a line end is a token of its own
        before a letter, a mark or a single space.
        """
        runs, lines, older = [], [], self.older
        back = [w for w in new if w in older]
        self.known.update(zip(back, map(older.__getitem__, back), strict=True))
        for word in [w for w in new if w not in older] if back else new:
            if word.isalpha() or word[0] == 0x20 and word[1:].isalpha():
                runs.append(word)
                continue
            text = word.decode()
            if not text[-1].isalnum():
                self.odd.add(word)
            stem = text.removeprefix(" ")
            if stem.isalpha() and max(stem) < SCRIPT_END:
                runs.append(word)
            elif stem.isalnum() or len(stem.split()) == 1 and stem == stem.strip():
                lines.append((word, text))
            else:
                self.known[word] = None
        self._merge(runs)
        line_end = np.frombuffer(self.fixed[LINE], "<u2")[0]
        for i in range(0, len(lines), 256):
            some = lines[i : i + 256]
            ids = self._ids("\n".join([text for _, text in some]))
            ends = (np.flatnonzero(np.frombuffer(ids, "<u2") == line_end) * 2).tolist()
            starts = [0, *[end + 2 for end in ends]]
            self.known.update((w, ids[a:b]) for (w, _), a, b in zip(some, starts, [*ends, len(ids)], strict=True))

    def _merge(self, runs: list[bytes]) -> None:
        """Ids of runs of letters, a few at a time."""
        merged = self.tokenizer.model.tokenize
        for i in range(0, len(runs), 1024):
            some = runs[i : i + 1024]
            tokens = [merged(spelt(w)) for w in some]
            ids = np.fromiter(map(ID, chain.from_iterable(tokens)), "<u2").tobytes()
            ends = [2 * n for n in accumulate(map(len, tokens))]
            self.known.update(zip(some, map(ids.__getitem__, map(slice, [0, *ends], ends)), strict=False))

    def encode(self, raw: np.ndarray, offsets: np.ndarray, end_id: int) -> Iterator[np.ndarray]:
        """Ids of each text, `raw` from one of `offsets` to the next, and the end id. The distinct
        words of all texts are looked up once, and the ids put together by places in arrays."""
        at, stuck = word_starts(raw, offsets)
        whole = np.zeros(len(offsets) - 1, bool)
        whole[np.searchsorted(offsets, stuck, "right") - 1] = True
        every = raw.tobytes()
        for token in self.added:
            found = every.find(token)
            while found >= 0:
                whole[np.searchsorted(offsets, found, "right") - 1] = True
                found = every.find(token, found + 1)
        bounds = pa.py_buffer(np.append(at, len(raw)).astype(np.int64))
        parts = pa.Array.from_buffers(pa.large_binary(), len(at), [None, bounds, pa.py_buffer(raw)])
        coded = parts.dictionary_encode()
        codes = coded.indices.to_numpy()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = list(map(self.known.get, words))
        gaps = [k for k, i in enumerate(ids) if i is None]
        new = [words[k] for k in gaps if words[k] not in self.known]
        self._learn(new)
        # A text stays whole if a word cannot be cut out, or if a point or comma follows a
        # word that ends in a mark: one token may hold both.
        stays = np.zeros(len(words), bool)
        for k in gaps:
            ids[k] = self.known[words[k]]
            if ids[k] is None:
                stays[k], ids[k] = True, b""
        stays = stays[codes]
        if self.odd:
            odd, mark = np.zeros(len(words), bool), np.zeros(len(words), bool)
            odd[[k for k, w in enumerate(words) if w in self.odd]] = True
            mark[[words.index(m) for m in (POINT, COMMA) if m in words]] = True
            stays[:-1] |= odd[codes[:-1]] & mark[codes[1:]]
        whole[np.searchsorted(offsets, at[stays], "right") - 1] = True
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 2
        starts = np.cumsum(lengths) - lengths
        sizes = lengths[codes]
        upto = np.append(0, np.cumsum(sizes))
        place = np.arange(upto[-1]) + np.repeat(starts[codes] - upto[:-1], sizes)
        last = upto[np.searchsorted(at, offsets[1:])]
        tokens = np.insert(np.frombuffer(b"".join(ids), "<u2")[place], last, end_id)
        ends = (last + np.arange(1, len(offsets))).tolist()
        for k, (a, b) in enumerate(zip([0, *ends], ends, strict=False)):
            if whole[k]:
                text = every[offsets[k] : offsets[k + 1]].decode()
                yield np.append(np.frombuffer(self._ids(text), "<u2"), np.uint16(end_id))
            else:
                yield tokens[a:b]
        self._forget(new)

    def _forget(self, new: list[bytes]) -> None:
        for word in [w for w in new if len(w) > KEPT_LENGTH]:
            del self.known[word]
            self.odd.discard(word)
        if len(self.known) > KEPT_WORDS // 2:
            self.known, self.older = dict(self.fixed), self.known
            self.odd = {w for w in self.odd if w in self.older}


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per worker process and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def text_runs(texts: pa.Array, limit: int = RUN_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes and offsets of runs of whole texts, each closed at `limit` bytes; NULL is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        after = min(int(np.searchsorted(offsets, offsets[first] + limit)), len(texts))
        after = max(after, first + 1)
        own = offsets[first : after + 1]
        yield raw[own[0] : own[-1]], own - own[0]
        first = after


def encode_texts(
    path: str, texts: Sequence[str | None] | pa.Array, end_id: int = END_ID
) -> Iterator[np.ndarray]:
    """Ids of each text with the end id after them."""
    for run in text_runs(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())):
        yield from encoder(path).encode(*run, end_id)
