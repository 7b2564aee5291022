"""BPE encoding and decoding with a tokenization automaton.

The automaton's states are "after token a" (and the start); its arcs carry tokens. It accepts
exactly those token sequences that applying the merges in order of rank can leave. It is
built merge by merge: the gadget of a merge (u, v) -> w takes the arc v away from the state
after u, and gives every state that had the arc u an arc w, whose end state inherits the arcs
of the state after v. Written out for every pair of tokens the table would have billions of
arcs; so the gadgets' outcome for a pair (a, b) is compiled when the pair is first met, and
stays in the table. As one sequence at most is accepted for a word, encoding is a walk over
table entries from the word's start that takes the longest arc first and remembers dead ends.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import importable, table, text_or_empty

NEVER = 1 << 60
CACHED_WORDS = 250_000


class TokenizationAutomaton:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        vocab: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.label = [""] * size
        for token, i in [*vocab.items(), *self.special.items()]:
            self.label[i] = token
        self.left, self.right, self.rank = [-1] * size, [-1] * size, [-1] * size
        self.merge: dict[int, int] = {}
        self.size = size
        for rank, pair in enumerate(model["merges"]):
            u, v = (vocab[x] for x in (pair if isinstance(pair, list) else pair.split(" ")))
            w = vocab["".join((self.label[u], self.label[v]))]
            self.left[w], self.right[w], self.rank[w] = u, v, rank
            self.merge[u * size + v] = rank
        self.arcs: dict[int, bool] = {}
        self.inner: dict[str, int] = {}
        self.final: dict[str, int] = {}
        made = [True] * size
        by_rank = sorted((r, w) for w, r in enumerate(self.rank) if r >= 0)
        for rank, w in by_rank:
            u, v = self.left[w], self.right[w]
            made[w] = made[u] and made[v] and not self._crossed(u, v, rank)
        for token, i in vocab.items():
            if made[i] and i not in self.special.values():
                if self.end and token.endswith(self.end):
                    self.final[token[: -len(self.end)]] = i
                else:
                    self.inner[token] = i
        self.longest = max(map(len, [*self.inner, *self.final]))

    def _crossed(self, a: int, b: int, until: int) -> bool:
        """Whether, before rank `until`, a gadget takes arc b from the state after a.

        x runs over the arcs that became a's right end, y over those that became b's left
        end, each with the rank of the merge that consumed it. Of equal merges the leftmost
        is applied first.
        """
        x, x_until = a, until
        while x >= 0:
            y, y_until = b, until
            while y >= 0:
                rank = self.merge.get(x * self.size + y, NEVER)
                if rank < x_until and rank <= y_until:
                    return True
                y, y_until = self.left[y], self.rank[y]
            x, x_until = self.right[x], self.rank[x]
        return False

    def arc(self, a: int, b: int) -> bool:
        key = a * self.size + b
        there = self.arcs.get(key)
        if there is None:
            there = self.arcs[key] = not self._crossed(a, b, NEVER)
        return there

    def encode(self, word: str) -> list[int]:
        """Ids of one pre-split word (in the byte alphabet of the vocabulary)."""
        whole = self.final.get(word)
        if whole is not None:
            return [whole]
        inner, final, arcs, size = self.inner, self.final, self.arcs, self.size
        n, out, starts, dead = len(word), [], [], set()
        pos, prev, stop = 0, -1, min(n, self.longest)
        while pos < n:
            found = -1
            while stop > pos:
                found = final.get(word[pos:], -1) if stop == n else inner.get(word[pos:stop], -1)
                if found >= 0 and (stop, found) not in dead:
                    there = prev < 0 or arcs.get(prev * size + found)
                    if there or there is None and self.arc(prev, found):
                        break
                found = -1
                stop -= 1
            if found >= 0:
                out.append(found)
                starts.append(pos)
                pos, prev, stop = stop, found, min(n, stop + self.longest)
            elif out:
                dead.add((pos, out.pop()))
                stop, pos = pos - 1, starts.pop()
                prev = out[-1] if out else -1
            else:
                raise ValueError(f"no token sequence for {word!r}")
        return out


#: The vocabulary's pre-splitting pattern, restricted to the Latin-1 range.
LATIN_WORDS = re.compile(
    r"[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|'s|'t|'re|'ve|'m|'ll|'d"
    r"|[^\t-\r \x85\xa0a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+"
)


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 bytes for themselves, the
    others, in order, for the code points from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class WordEncoder(dict):
    """Pre-split word -> `make(its ids)`, filled on demand.

    When the words of this generation reach `most`, they become the old generation, from
    which words still in use come back; the old one before is forgotten.
    """

    def __init__(self, path: str, make=None, most: int = CACHED_WORDS):
        super().__init__()
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.normalize = tokenizer.normalizer.normalize_str
        self.pre_split = tokenizer.pre_tokenizer.pre_tokenize_str
        self.automaton = TokenizationAutomaton(path)
        self.specials = re.compile("(" + "|".join(map(re.escape, self.automaton.special)) + ")")
        self.letters = byte_letters()
        self.byte_of = {c: b for b, c in enumerate(self.letters)}
        self.make, self.most, self.old = make or list, most, {}

    def split(self, text: str) -> list[str]:
        """The words of a text, as the vocabulary's normalizer and pre-splitter give them."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            mapped = self.pre_split(self.normalize(text))
            return [bytes(map(self.byte_of.__getitem__, word)).decode() for word, _ in mapped]
        return LATIN_WORDS.findall(text.lower())

    def values(self, text: str) -> list:
        """make() of each word in turn; special tokens written in the text are found first."""
        if not any(x in text for x in self.automaton.special):
            return list(map(self.__getitem__, self.split(text)))
        out = []
        for part in self.specials.split(text):
            special = self.automaton.special.get(part)
            out += list(map(self.__getitem__, self.split(part))) if special is None else [self.make([special])]
        return out

    def __missing__(self, word: str):
        made = self.old.get(word)
        if made is None:
            letters = word if word.isascii() and word.isalpha() else "".join([self.letters[b] for b in word.encode()])
            made = self.make(self.automaton.encode(letters))
        if len(word) <= 100:
            self[word] = made
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
                if len(self.automaton.arcs) > 4 * self.most:
                    self.automaton.arcs.clear()
        return made


@lru_cache(maxsize=2)
def _texts_encoder(path: str) -> WordEncoder:
    encoder = WordEncoder(path)
    label = encoder.automaton.label
    encoder.make = lambda ids: (" ".join(map(str, ids)), " ".join([label[i] for i in ids]))
    return encoder


def encode_text(path: str, text: str | None) -> tuple[str, str]:
    """Decimal ids and arc labels of a text, each joined by single spaces."""
    found = _texts_encoder(path).values(text or "")
    return " ".join([x[0] for x in found]), " ".join([x[1] for x in found])


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", full: bool = True) -> DataFrame:
    """Per row: id, n_tokens, ids_sha256, decoded_sha256 and, if `full`, ids and decoded.

    `path` names the vocabulary file, which every executor must have. A null text counts as
    empty (no tokens, the digest of the empty string); special tokens written out in a text
    become their ids; a null id stays null; repeated rows give repeated results; texts of any
    length are encoded whole. Other columns are left out.
    """
    fields = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    fields += [("ids", pa.list_(pa.int32())), ("decoded", pa.string())] if full else []
    rows = docs.select(F.col(id_col), text_or_empty(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in fields]
            for text in batch.column(1):
                ids, decoded = encode_text(path, text.as_py())
                row = [ids.count(" ") + 1 if ids else 0, *(hashlib.sha256(x.encode()).hexdigest() for x in (ids, decoded))]
                row += [[int(x) for x in ids.split()], decoded] if full else []
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, (_, t) in zip(out, fields, strict=True))], [id_col, *(n for n, _ in fields)]
            )

    importable(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return rows.mapInArrow(run, schema + (", ids array<int>, decoded string" if full else ""))


def op3_bpe(spark, sf_dir):
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return bpe_encode(docs, public_tokenizers.path("word_bpe_49k.json"), full=False)
