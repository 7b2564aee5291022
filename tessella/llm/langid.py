"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text gives, at every place of a text, the
longest match with that text. Parsing a text greedily into longest matches needs few phrases
in its own language and many in others; the language with the fewest phrases a symbol wins.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import gathered, importable, lean, table

UNKNOWN = "und"
#: The bound of the labelled sample: at most SAMPLE_ROWS different texts a language, each whole
#: and of at most SAMPLE_TEXT characters, and no more of them than make up SAMPLE_CHARS.
SAMPLE_ROWS, SAMPLE_TEXT, SAMPLE_CHARS = 160, 10_000, 40_000
#: Symbols that are parsed together, and what of them is left to the scan of single texts.
BLOCK, LEAST_LANES, PART = 1 << 22, 24, 1 << 20
#: Bytes of the dense part of the transition table.
DENSE = 1 << 25
#: A text with more phrases a symbol than this, in its best language, is in no learned language.
MOST_PHRASES = 0.5


def id_hash(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")))


def labelled_sample(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[tuple[str, tuple[str, ...]], ...]:
    """(language, its texts) of a bounded sample, ordered by language.

    Of each language's different texts of at most SAMPLE_TEXT characters those with the least
    hashes are taken, whole, up to SAMPLE_ROWS of them and SAMPLE_CHARS characters in all. A
    language that has longer texts only is learned from its shortest one. Copies of a text
    count once. Rows without a text or language take no part; an empty table gives nothing.
    """
    rows = (
        labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
        .select(F.col(lang_col).cast("string").alias("_lang"), F.col(text_col).alias("_text"))
        .select("_lang", F.xxhash64("_text").alias("_key"), "_text", F.length("_text").alias("_n"))
    )
    short = F.col("_n") <= SAMPLE_TEXT
    counts = rows.groupBy("_lang", "_key").agg(F.min("_n").alias("_n")).groupBy("_lang").agg(F.count_if(short).alias("_count"))
    known = rows.join(F.broadcast(counts), "_lang")  # a row a language
    # twice the rate that is needed, so that too few come with no odds to speak of; then the least
    order = f"over (partition by _lang order by pmod(_key, {1 << 30}), _key"
    sampled = (
        known.where(short & (F.pmod("_key", F.lit(1 << 30)) < F.try_divide(F.lit(float(2 * SAMPLE_ROWS << 30)), "_count")))
        .groupBy("_lang", "_key")
        .agg(F.min("_text").alias("_text"))
        .withColumn("_rank", F.expr(f"row_number() {order})"))
        .where(F.col("_rank") <= SAMPLE_ROWS)
        .withColumn("_sum", F.expr(f"sum(length(_text)) {order} rows unbounded preceding)"))
        .where((F.col("_rank") == 1) | (F.col("_sum") <= SAMPLE_CHARS))
        .select("_lang", "_key", "_text")
    )
    others = known.where("_count = 0").groupBy("_lang").agg(F.min_by("_text", F.struct("_n", "_key")).alias("_text"))
    texts: dict[str, list[str]] = {}
    for lang, _, text in sorted(map(tuple, sampled.unionByName(others.select("_lang", F.lit(0).cast("long").alias("_key"), "_text")).collect())):
        texts.setdefault(lang, []).append(text)
    return tuple((lang, tuple(x)) for lang, x in sorted(texts.items()))


def _suffix_automaton(texts: list[list[int]]) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings of the texts; state 0 is the start."""
    step: list[dict[int, int]] = [{}]
    link, length = [-1], [0]

    def cloned(p: int, c: int) -> int:
        """The state of p's arc c, made to hold no more than one symbol more than p."""
        q = step[p][c]
        if length[q] == length[p] + 1:
            return q
        twin = len(step)
        step.append(dict(step[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = twin
        while p >= 0 and step[p].get(c) == q:
            step[p][c] = twin
            p = link[p]
        return twin

    for text in texts:
        last = 0
        for c in text:
            if c in step[last]:
                last = cloned(last, c)
                continue
            state = len(step)
            step.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p >= 0 and c not in step[p]:
                step[p][c] = state
                p = link[p]
            if p >= 0:
                link[state] = cloned(p, c)
            last = state
    return step


class CrossParser:
    """Phrase counts of texts in each learned language.

    A phrase is the longest match, from where the last one ended, with a text of the language;
    a letter that the language has not is a phrase of its own. The automata of all languages
    are one table: states with several arcs have a row for the commonest symbols, and sorted
    keys for the others; states with one arc have just that.
    """

    def __init__(self, sample: tuple[tuple[str, tuple[str, ...]], ...]):
        self.langs = [lang for lang, _ in sample]
        letters = Counter(c for _, texts in sample for text in texts for c in text.lower() if c.isalpha())
        known = sorted(letters, key=lambda c: (-letters[c], c))
        self.width = len(known) + 2  # 0: between words, last: letters not known
        # symbols of all code points; letters not known get the last
        self.symbol = np.zeros(0x110000, np.int32)
        self.symbol[[i for i in range(0x110000) if chr(i).isalpha()]] = self.width - 1
        for k, c in enumerate(known, 1):
            self.symbol[ord(c)] = k
        self.start, firsts = [], np.zeros((self.width, max(1, len(sample))), np.int32)
        one, to, many = [], [], []  # by state: its only arc; (state, its arcs)
        for k, (_, texts) in enumerate(sample):
            step, base = _suffix_automaton([self.symbols(text)[0].tolist() for text in texts]), len(one)
            # a state without arcs, from which each symbol begins a phrase, in place of state 0
            firsts[:, k] = base
            for c, x in step[0].items():
                firsts[c, k] = base + x
            step[0] = {}
            self.start.append(base)
            for state, arcs in enumerate(step, base):
                single = len(arcs) == 1
                one.append(next(iter(arcs)) if single else -1)
                to.append(base + arcs[one[-1]] if single else -1)
                if len(arcs) > 1:
                    many.append((state, base, arcs))
        self.firsts, self.one, self.to = firsts.ravel(), np.array(one, np.int32), np.array(to, np.int32)
        self.common = int(max(1, min(self.width, 64, DENSE // (4 * len(many) + 4))))
        self.row = np.zeros(len(one), np.int32)  # row 0 has no arcs
        self.dense = np.full((len(many) + 1) * (self.common + 1), -1, np.int32)
        keys, ends = [], []
        for r, (state, base, arcs) in enumerate(many, 1):
            self.row[state] = at = r * (self.common + 1)
            for c, x in arcs.items():
                if c < self.common:
                    self.dense[at + c] = base + x
                else:
                    keys.append(state * self.width + c)
                    ends.append(base + x)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.ends = np.array(keys, np.int64)[order], np.array(ends, np.int32)[order]
        self.rare = dict(zip(self.keys.tolist(), self.ends.tolist(), strict=True))

    def symbols(self, text: str, after_gap: bool = False) -> tuple[np.ndarray, bool]:
        """The symbols of a text, and whether it ends between words."""
        found = self.symbol[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
        keep = found > 0
        keep[1:] |= found[:-1] > 0  # one symbol for all that stands between two words
        if len(keep) and not after_gap:
            keep[0] = True
        return found[keep], bool(len(found)) and found[-1] == 0

    def _scan(self, symbols: list[int], states: list[int], counts: list[int]) -> None:
        """Goes on with one text, in place."""
        one, to, row, dense, firsts = map(memoryview, (self.one, self.to, self.row, self.dense, self.firsts))
        common, width, n = self.common, self.width, len(self.langs)
        for k in range(n):
            s, phrases = states[k], counts[k]
            for c in symbols:
                if one[s] == c:
                    s = to[s]
                else:
                    x = dense[row[s] + c] if c < common else self.rare.get(s * width + c, -1)
                    if x < 0:
                        phrases += 1
                        x = firsts[c * n + k]
                    s = x
            states[k], counts[k] = s, phrases

    def phrases(self, parts: list[np.ndarray]) -> np.ndarray:
        """Per part (row) and language (column) the number of phrases."""
        sizes, n = np.array([len(x) for x in parts]), len(self.langs)
        order = np.argsort(-sizes, kind="stable")
        flat = np.concatenate([parts[k] for k in order.tolist()]) if len(parts) else np.zeros(0, np.int32)
        sizes = sizes[order]
        at = np.cumsum(sizes) - sizes
        state = np.tile(np.array(self.start, np.intp), len(parts))
        count = np.zeros(len(parts) * n, np.int32)
        lang = np.tile(np.arange(n), len(parts))
        active = len(parts) - np.searchsorted(sizes[::-1], np.arange(int(sizes[0]) + 1 if len(sizes) else 0), side="right")
        t, m = 0, len(parts)
        while t < len(active) and (m := int(active[t])) >= LEAST_LANES:
            c = np.repeat(flat.take(at[:m] + t), n)
            s = state[: m * n]
            row = self.row.take(s)
            to = self.dense.take(row + (c if self.width == self.common else np.minimum(c, self.common)))
            i = np.flatnonzero(row == 0)
            single = s.take(i)
            to[i] = np.where(self.one.take(single) == c.take(i), self.to.take(single), -1)
            if len(self.keys):
                i = np.flatnonzero((c >= self.common) & (to < 0))
                key = s[i] * self.width + c[i]
                j = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                to[i] = np.where(self.keys[j] == key, self.ends[j], -1)
            i = np.flatnonzero(to < 0)
            count[i] += 1
            to[i] = self.firsts.take(c.take(i) * n + lang.take(i))
            state[: m * n] = to
            t += 1
        for k in range(m if t < len(active) else 0):
            states, counts = state[k * n : k * n + n].tolist(), count[k * n : k * n + n].tolist()
            self._scan(flat[at[k] + t : at[k] + sizes[k]].tolist(), states, counts)
            count[k * n : k * n + n] = counts
        out = np.zeros((len(parts), n))
        out[order] = count.reshape(-1, n)
        return out

    def _long(self, text: str) -> tuple[np.ndarray, int, bool]:
        """Phrases, symbols and whether there is a letter, of a text that is parsed part by part."""
        states, counts, n, lettered, gap = list(self.start), [0] * len(self.langs), 0, False, False
        for at in range(0, len(text), PART):
            part, gap = self.symbols(text[at : at + PART], gap)
            self._scan(part.tolist(), states, counts)
            n, lettered = n + len(part), lettered or bool(part.any())
        return np.array(counts, float), n, lettered

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """(language, score, phrases a symbol) of each text.

        The score is 1 less the ratio of the best to the second phrase count.
        """
        total = np.zeros((len(texts), max(1, len(self.langs))))
        symbols = np.zeros(len(texts), np.int64)
        lettered = np.zeros(len(texts), bool)
        parts: list[np.ndarray] = []
        owner: list[int] = []

        def flush() -> None:
            if parts and self.langs:
                total[owner] = self.phrases(parts)
            parts.clear()
            owner.clear()

        held = 0
        for k, text in enumerate(texts):
            if len(text or "") > PART and self.langs:
                total[k], symbols[k], lettered[k] = self._long(text)
            elif text:
                part, _ = self.symbols(text)
                lettered[k], symbols[k] = bool(part.any()), len(part)
                parts.append(part)
                owner.append(k)
                held += len(part)
                if held >= BLOCK:
                    flush()
                    held = 0
        flush()
        out = []
        for k in range(len(texts)):
            if not lettered[k] or not self.langs:
                out.append((UNKNOWN, 0.0, 1.0))
                continue
            best = int(np.argmin(total[k]))
            second = np.partition(total[k], 1)[1] if len(self.langs) > 1 else float(symbols[k])
            score = 1 - total[k, best] / second if second > 0 else 0.0
            out.append((self.langs[best], float(min(1.0, max(0.0, score))), float(min(1.0, total[k, best] / symbols[k]))))
        return out


@lru_cache(maxsize=1)  # some MB a language
def _parser(sample: tuple[tuple[str, tuple[str, ...]], ...]) -> CrossParser:
    return CrossParser(sample)


def identify(docs: DataFrame, sample: tuple[tuple[str, tuple[str, ...]], ...], text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Adds lang_pred, score and phrase_rate to each row, from its whole text.

    Languages are tried in the order of their names, so that the first wins a tie. A null
    text, or one without a letter, gets `und`, score 0 and phrase_rate 1; so does every text
    if nothing was learned. Only the text is read: null ids, repeated rows and further
    columns (`carry`, default all) pass as they are; columns named like the new ones are replaced.
    """
    importable(docs.sparkSession)
    new = [("lang_pred", pa.string()), ("score", pa.float64()), ("phrase_rate", pa.float64())]
    carry = [c for c in (docs.columns if carry is None else carry) if c not in dict(new)]
    rows = docs.select(*carry, *([] if text_col in carry else [text_col]))
    at = rows.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(sample)
        for batch in gathered(batches, at, BLOCK):
            found = parser.predict(batch.column(at).to_pylist())
            columns = list(zip(*found, strict=True)) if found else [[]] * 3
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(carry)], *(pa.array(c, t) for c, (_, t) in zip(columns, new, strict=True))], [*carry, *dict(new)]
            )

    schema = rows.select(*carry).schema.add("lang_pred", "string").add("score", "double").add("phrase_rate", "double")
    return rows.mapInArrow(lean(run), schema)


def op6_langid(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("held_out", id_hash() % 4 == 2)
    sample = labelled_sample(docs.where("not held_out"))
    return identify(docs, sample, carry=["doc_id", "held_out"]).select("doc_id", "held_out", "lang_pred", "score")


def langid_stage(spark, docs, sf_dir):
    """Pipeline stage: documents in no learned language go, as do null texts and ones without a
    letter; the others stay as they are, repeated rows and null ids too. Where nothing is
    labelled nothing can be learned, and an empty table gives no rows: then none stays."""
    sample = labelled_sample(docs)
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select("text", F.struct(*others).alias("_doc"))  # columns may have the new names
    found = identify(rows, sample).where((F.col("lang_pred") != UNKNOWN) & (F.col("phrase_rate") <= MOST_PHRASES))
    return found.select(*[F.col(c if c == "text" else f"_doc.{c}").alias(c) for c in docs.columns])
