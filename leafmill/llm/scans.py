"""Noise in text from scanned pages: headers, page numbers, cut words, misread characters.

1. The current pages are read once and written in blocks of about a million characters, as numbers of
   tokens, with what can be said of their lines without knowing the corpus.
2. Words are counted a block before the shuffle and grouped by their *skeleton*, in which glyphs that
   scanners confuse are the same. In each group the frequent forms stand; a form that is rarer by
   ``RATIO`` is a misreading. Context chooses among standing forms: what follows the word before most
   often is meant, and a standing form whose neighbours support another one is misread too. Names are
   too many to be frequent: the words that names follow are learned from the counts, and names
   are judged by the character trigrams of all names.
3. Each block gets, by joins on its own words, a lexicon of those words; lines are marked with it.
4. Lines at the top and bottom of pages are compared within a book after masking digits; page
   numbers are recognised by their dress. Compounds with a hyphen of their own are known from the
   insides of lines.
5. Pages are reflowed by SQL windows over their lines, which the lexicon has put right.

Counts, forms and choices cover all current pages, without caps; nothing is collected. What joins on
a word is one row a block, spread over several keys where blocks are very many.

Defined cases: null, empty and blank contents have no noise; the latest row of a page counts, equal
copies once; a book's first page has no header; page_ocr_needed, ocr_status and content_len are not
trusted and not read; other columns are not read.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.text import strip
from leafmill.llm import kernel
from leafmill.tables import current_rows, updated
from leafmill.work import stage

#: A form is a misreading if a form of its skeleton is so many times as frequent, and occurs so often.
RATIO, FREQUENT = 20, 10
#: Uses inside lines that make a hyphenated word a compound of its own.
COMPOUND = 3
#: What names follow: its uses at least, and its share of rare words after it against that of all words.
LEAST_CONTEXT, OPEN = 50, 5.0
#: Pages in a block; blocks in which a word may occur before its rows are spread over several keys.
MOST_PAGES, MOST_BLOCKS = 1 << 16, 100_000
#: Header keys of one side that are compared at once; letters in which a damaged header may differ from a whole one; in short ones a single letter.
CELL, NEAR, SHORT_HEADER = 100_000, 3, 8

#: Glyphs that are misread, as (read, meant).
CONFUSED = (
    ("rn", "m"), ("ri", "n"), ("cl", "d"), ("vv", "w"), ("lc", "k"), ("ii", "u"), ("ьi", "ы"),
    ("@", "a"), ("c", "e"), ("l", "i"), ("1", "i"), ("f", "t"), ("5", "s"), ("q", "g"), ("b", "h"), ("0", "o"),
    ("m", "т"), ("с", "е"), ("н", "и"), ("л", "п"), ("д", "п"), ("6", "б"), ("3", "з"), ("о", "o"), ("а", "a"),
    ("ى", "ي"), ("ش", "س"), ("ت", "ب"), ("ن", "ب"), ("ث", "ب"), ("پ", "ب"), ("ٹ", "ب"), ("ں", "ب"), ("ذ", "د"), ("ڈ", "د"), ("ف", "ق"), ("ض", "ص"), ("ح", "ج"), ("خ", "ج"), ("چ", "ج"),
    ("ه", "ة"), ("ز", "ر"), ("ڑ", "ر"), ("ا", "i"), ("ظ", "ط"), ("غ", "ع"), ("ے", "ی"), ("گ", "ک"),
)


def _expansions() -> dict[str, str]:
    """What each glyph becomes in a skeleton: a glyph that is read as several becomes those.

    As every glyph is replaced on its own, a misreading anywhere in a word leaves the skeleton as it was.
    """
    table = {meant: read for read, meant in CONFUSED if len(read) > 1} | {read: meant for read, meant in CONFUSED if len(read) == 1 and read != "m"}
    table["т"] = "m"
    for _ in range(4):
        table = {k: "".join(table.get(c, c) for c in v) for k, v in table.items()}
    return table


#: Marks at a line's end that cut a word; labels of page numbers.
MARKS = "-\u2010\u00ac\u00ad"
LABELS = ("page", "p", "pg", "pag", "halaman", "hal", "hlm", "sayfa", "syf", "s", "стр", "с", "страница", "صفحة", "الصفحة", "ص", "صفحہ", "صفحہ نمبر")
#: Marks that stand alone in clean text.
_ALONE = set("~;-—–?|.…=:!*#+&/،؛؟۔،")
_PLAIN = ("•", "«", "»", "(", ")", "[", "]", '"', "''")
_DIGITS = "0-9\u0660-\u0669\u06f0-\u06f9OolI"
_NUMBER = re.compile(rf"^\W*?(?:(?P<label>[^\W\d_]+(?: [^\W\d_]+)?)(?:\.\s*|\s+))?(?P<n>[{_DIGITS}]{{1,5}}|[ivxlc]{{1,8}})\s*[\]\-–—~|]?$")
_DRESS = re.compile(r"^[\[\-–—~|\s]*(.*?)[\]\-–—~|\s]*$", re.S)
_WITH_NUMBER = re.compile(rf"^(?:[{_DIGITS}]{{1,5}}\s{{2,}}(?P<a>\D.*)|(?P<b>.*\D)\s{{2,}}[{_DIGITS}]{{1,5}})$")
_ENDS = ".!?…؟۔:;,،؛»)\"”"
_INSIDE = re.compile(r"[.!?؟۔;:]\s|[,،]")
_TOKEN = re.compile("[^\\W_](?:[^\\W_]|[@'\u2019\u0300-\u036f\u064b-\u065f\u0670])*|@(?:[^\\W_]|[@'\u2019])+")
_AT_END = re.compile(rf"[{MARKS}][^\S\n]*(?:\n|\Z)")
_EXPANSIONS = _expansions()
_TRANSLATION = str.maketrans(_EXPANSIONS)


def skeleton(word: str) -> str:
    """The word with confusable glyphs made the same (Python; ``skeletons`` is the same in SQL)."""
    return word.translate(_TRANSLATION)


def skeletons(word: Column) -> Column:
    """The word with confusable glyphs made the same."""
    single = {k: v for k, v in _EXPANSIONS.items() if len(v) == 1}
    word = F.translate(word, "".join(single), "".join(single.values()))
    for k, v in _EXPANSIONS.items():
        if len(v) > 1:  # what glyphs become holds no glyph that becomes something else
            word = F.replace(word, F.lit(k), F.lit(v))
    return word


@functools.lru_cache(None)
def _tables() -> dict[str, np.ndarray]:
    plain = kernel.word_chars()
    mark = np.zeros(0x110000, bool)
    mark[[ord(c) for c in MARKS]] = True
    white = np.zeros(0x110000, bool)
    white[[9, 10, 11, 12, 13, 32, 0x85, 0xA0]] = True
    odd = np.zeros(0x110000, bool)
    odd[[ord(c) for c in "013569@"]] = True
    category = kernel.categories()
    latin = np.zeros(0x110000, bool)
    latin[0x41:0x250] = True
    cyrillic = np.zeros(0x110000, bool)
    cyrillic[0x400:0x530] = True
    return {"plain": plain, "mark": mark, "white": white, "odd": odd, "letter": category == ord("L"), "latin": latin & (category == ord("L")), "cyrillic": cyrillic}


class Tokens:
    """The tokens of a block of texts: words with the signs that scanners put inside them."""

    def __init__(self, texts: list[str | None]):
        t = _tables()
        self.texts = texts
        self.cp, self.begin, self.stop = kernel.encode([x.lower() if x else x for x in texts])
        cp = self.cp
        plain = t["plain"][cp]
        inner = np.zeros(len(cp), bool)
        quote = (cp == 39) | (cp == 0x2019)
        inner[1:-1] = quote[1:-1] & plain[:-2] & plain[2:]
        at = cp == 64
        inner[1:] |= at[1:] & plain[:-1]
        inner[:-1] |= at[:-1] & plain[1:]
        self.start, self.end = kernel.runs(plain | inner)
        self.hash = kernel.span_hashes(cp, self.start, self.end)
        letters = np.concatenate([[0], np.cumsum(t["letter"][cp])])
        self.word = letters[self.end] > letters[self.start]
        # A token is cut if a mark and a line feed follow it, or if the token before it is cut.
        last = np.minimum(self.end, len(cp) - 1)
        feeds = np.concatenate([[0], np.cumsum(cp == 10)])
        following = np.append(self.start[1:], len(cp))
        self.cut = t["mark"][cp[last]] & (feeds[following] > feeds[self.end])
        self.rest = np.concatenate([[False], self.cut[:-1]]) if len(self.cut) else self.cut
        #: Whether the token before stands right before this one, but for three signs at most.
        self.close = np.zeros(len(self.start), bool)
        if len(self.start) > 1:
            self.close[1:] = (self.start[1:] - self.end[:-1] < 4) & (self.text[1:] == self.text[:-1])
        odd = np.concatenate([[0], np.cumsum(t["odd"][cp])])
        latin = np.concatenate([[0], np.cumsum(t["latin"][cp])])
        cyrillic = np.concatenate([[0], np.cumsum(t["cyrillic"][cp])])
        count = lambda x: x[self.end] - x[self.start]
        self.odd = self.word & ((count(odd) > 0) | ((count(latin) > 0) & (count(cyrillic) > 0)))
        self.feeds = feeds

    @functools.cached_property
    def text(self) -> np.ndarray:
        """The number of each token's text."""
        return np.searchsorted(self.begin, self.start, side="right") - 1

    @functools.cached_property
    def line(self) -> np.ndarray:
        """The line within its text, from 0, on which each token begins."""
        return self.feeds[self.start] - self.feeds[self.begin][self.text]

    def string(self, i: int) -> str:
        return self.cp[self.start[i] : self.end[i]].tobytes().decode("utf-32-le", "surrogatepass")


def _within(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table) or not len(values):
        return np.zeros(len(values), bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


# --- The current pages, as blocks of tokens

_USE = "struct<word:string,uses:double,rare:double>"
_LINE = "struct<i:int,line:int,kind:string,key:string,start:int,size:int>"
_CUT = "struct<i:int,line:int,next:int,a:string,b:string,hyphen:boolean,at:int,to:int>"
_WORD, _CUTS, _REST, _CLOSE, _SURE = 1, 2, 4, 8, 16


def _kept(pages: DataFrame) -> DataFrame:
    """book_id, page_num, share, content of the current pages, as they lie in the scan.

    Keys that come back are settled by a join with the table of those keys, their last time and a hash of
    the content.
    Equal copies have a share of the page each; ``_copies`` names all but one of them.
    """
    rows = pages.select("book_id", "page_num", updated().alias("at"), F.col("content").cast("string").alias("content"))
    seen = rows.select("book_id", "page_num", "at", F.xxhash64("content").alias("print")).groupBy("book_id", "page_num", "at", "print").agg(F.count("*").alias("n"))
    last = seen.groupBy("book_id", "page_num").agg(F.sum("n").alias("rows"), F.max(F.struct("at", "print", "n")).alias("last")).where("rows > 1")
    again = stage(last.select(F.col("book_id").alias("b"), F.col("page_num").alias("p"), "last"), "again")
    same = F.col("book_id").eqNullSafe(F.col("b")) & F.col("page_num").eqNullSafe(F.col("p"))
    kept = rows.join(again.hint("merge"), same, "left").where("last IS NULL OR (at = last.at AND xxhash64(content) = last.print)")
    return kept.select("book_id", "page_num", F.coalesce(1.0 / F.col("last.n"), F.lit(1.0)).alias("share"), "content")


def token_blocks(pages: DataFrame) -> DataFrame:
    """The current pages in blocks of about a million characters, each one row, written once.

    block, books, nums, shares: the pages; words, numbers, flags, places, gaps, counts: the distinct
    tokens and, a token, its number among them, its flags, the lines and characters since the token
    before, and the tokens of each page; uses: the words to count; asked: words that are only looked up; lines: what is
    noise, or may be, without knowing the corpus; cuts: lines that end inside a word. All that comes
    after reads this table, not the texts.
    """
    kept = _kept(pages)
    kind = kept.schema["page_num"].dataType.simpleString()
    schema = f"block long, books array<string>, nums array<{kind}>, shares array<double>, words array<string>, numbers binary, flags binary, places binary, gaps binary, counts binary, uses array<{_USE}>, asked array<string>, lines array<{_LINE}>, cuts array<{_CUT}>"
    return stage(kept.mapInArrow(_read, schema), "token-blocks")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    first, serial = TaskContext.get().partitionId() << 36, 0
    for batch in batches:
        texts = batch.column(3).to_pylist()
        for a, b in kernel.blocks(texts):
            for c in range(a, b, MOST_PAGES):
                part = batch.slice(c, min(MOST_PAGES, b - c))
                own = encoded(texts[c : c + part.num_rows], part.column(2).to_numpy())
                lists = [_listed(pa.concat_arrays([part.column(i)])) for i in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array([first + serial * MOST_PAGES], pa.int64()), *lists, *own.values()], ["block", "books", "nums", "shares", *own])
                serial += 1


def _listed(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _structs(rows: list[tuple], fields: str) -> pa.Array:
    kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
    names = [f.split(":") for f in fields[fields.index("<") + 1 : -1].split(",")]
    return _listed(pa.StructArray.from_arrays([pa.array([r[i] for r in rows], kinds[t]) for i, (_, t) in enumerate(names)], [n for n, _ in names]))


def _small(values: np.ndarray) -> pa.Array:
    """Integers, as they are narrowest: the first byte is their width."""
    most = int(values.max()) if len(values) else 0
    width = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4
    return pa.array([bytes([width]) + values.astype(f"<u{width}").tobytes()], pa.binary())


def _wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def _lengths(words: list[str]) -> np.ndarray:
    """Characters of each word in the text: a dotted capital I is two in lower case."""
    return np.array([len(w) - w.count("i\u0307") for w in words] or [0], np.int64)


def _steps(values: np.ndarray, lengths: np.ndarray, text: np.ndarray) -> pa.Array:
    """What each value is beyond the one before it and its length, within a text; small numbers mostly, that compress."""
    before = np.concatenate([np.zeros(min(1, len(values)), np.int64), (values + lengths)[:-1]])
    before[np.concatenate([np.ones(min(1, len(text)), bool), text[1:] != text[:-1]])] = 0
    step = values - before
    return _small(np.where(step < 0, -2 * step - 1, 2 * step))


def _sums(data: bytes, lengths: np.ndarray, page: np.ndarray) -> np.ndarray:
    """The values that ``_steps`` wrote."""
    step = _wide(data)
    step = np.where(step & 1, -(step + 1) >> 1, step >> 1)
    total = np.cumsum(step + lengths) - lengths
    first = np.concatenate([np.ones(min(1, len(page)), bool), page[1:] != page[:-1]])
    start = np.repeat(total[first] - step[first], np.diff(np.append(np.flatnonzero(first), len(page))))
    return total - start


def encoded(texts: list[str | None], shares: np.ndarray) -> dict[str, pa.Array]:
    """The columns of a block that ``token_blocks`` describes."""
    t = Tokens(texts)
    _, first, number = np.unique(t.hash, return_index=True, return_inverse=True)
    words = [t.string(i) for i in first]
    start = t.start - t.begin[t.text]
    sure: dict[int, set[int]] = {}
    lines: list[tuple] = []
    cuts: list[tuple] = []
    for k, text in enumerate(texts):
        if not text:
            continue
        if not text.isascii() and len(text.lower()) != len(text):
            # Lower case may be longer; places are those in the text as it is.
            place, own = np.cumsum([0] + [len(c.lower()) for c in text]), t.text == k
            start[own] = np.searchsorted(place, start[own])
        split = text.split("\n")
        edge = edges(split)
        lines += [(k, i, kind, key, None, None) for i, kind, key in edge]
        sure[k] = {i for i, kind, _ in edge if not kind.startswith("header?")}
        if _AT_END.search(text):
            cuts += [(k, *cut) for cut in _cuts(split, {i for i, _, _ in edge})]
    certain = np.fromiter((i in sure.get(k, ()) for k, i in zip(t.text.tolist(), t.line.tolist())), bool, len(t.text)) if any(sure.values()) else np.zeros(len(t.text), bool)
    odd = np.flatnonzero(t.odd & ~t.cut & ~t.rest & ~certain)
    bad = {(k, i) for k, i in zip(t.text[odd].tolist(), t.line[odd].tolist())}
    for k, a, b in _specks(t):
        at = a - int(t.begin[k])
        lines.append((k, int(t.feeds[a] - t.feeds[t.begin[k]]), "speck", None, at, b - a))
        if lines[-1][1] not in sure.get(k, ()):
            bad.add((k, lines[-1][1]))
    lines += [(k, i, "misread", None, None, None) for k, i in sorted(bad)]
    flags = t.word * _WORD + t.cut * _CUTS + t.rest * _REST + t.close * _CLOSE + certain * _SURE
    asked = {x for _, _, _, a, b, *_ in cuts if a and b for x in (a + b, _compound(a, b))}
    counts = np.bincount(t.text, minlength=len(texts)) if len(t.text) else np.zeros(len(texts), np.int64)
    return {
        "words": _listed(pa.array(words, pa.string())), "numbers": _small(number), "flags": pa.array([flags.astype(np.uint8).tobytes()], pa.binary()), "places": _steps(t.line, np.zeros(len(t.line), np.int64), t.text), "gaps": _steps(start, _lengths(words)[number], t.text),
        "counts": _small(counts), "uses": _structs(_uses(t, words, number, shares), _USE), "asked": _listed(pa.array(sorted(asked - set(words)), pa.string())), "lines": _structs(lines, _LINE), "cuts": _structs(cuts, _CUT),
    }


def _uses(t: Tokens, words: list[str], number: np.ndarray, shares: np.ndarray) -> list[tuple]:
    """(word, uses, rare uses) of a block; compounds are skeletons with a hyphen.

    The rare uses of a word are those right after which there is a word that occurs twice at most in the
    block. Words that are cut at a line's end have no uses.
    """
    ok = np.flatnonzero(t.word & ~t.cut & ~t.rest)
    size = np.bincount(number[ok], minlength=len(words))
    uses = np.bincount(number[ok], shares[t.text[ok]], len(words))
    after = ok[t.close[ok] & (size[number[ok]] <= 2)]
    rare = np.bincount(number[after - 1], shares[t.text[after]], len(words))
    rows = [(words[i], float(uses[i]), float(rare[i])) for i in np.flatnonzero((uses > 0) | (rare > 0)).tolist()]
    if len(t.start) > 1:
        gap = np.flatnonzero((t.start[1:] - t.end[:-1] == 1) & (t.cp[np.minimum(t.end[:-1], len(t.cp) - 1)] == 45) & t.word[1:] & t.word[:-1])
        _, at, which = np.unique(number[gap] * len(words) + number[gap + 1], return_index=True, return_inverse=True)
        total = np.bincount(which, shares[t.text[gap]], len(at))
        rows += [(_compound(words[number[i]], words[number[i + 1]]), n, 0.0) for i, n in zip(gap[at].tolist(), total.tolist())]
    return rows


def _cuts(lines: list[str], skip: set[int]) -> list[tuple[int, int, str, str, bool, int, int]]:
    """(line, next line, what is before the mark, what comes after, whether the mark is a hyphen, places of both) of the lines that end inside a word."""
    out = []
    for i, line in enumerate(lines):
        s = line.rstrip()
        if len(s) < 2 or s[-1] not in MARKS or not (s[-2].isalnum() or s[-2] == "@") or i in skip:
            continue
        j = i + 1
        while j < len(lines) and (j in skip or not lines[j].strip()):
            j += 1
        a = _TOKEN.findall(s[:-1].lower())
        after = lines[j].lstrip() if j < len(lines) else ""
        b = _TOKEN.match(after.lower())
        offset = lambda n: sum(len(x) + 1 for x in lines[:n])
        head = a[-1] if a else ""
        out.append((i, j, head, b.group() if b else "", s[-1] == "-", offset(i) + len(s) - 1 - len(head), offset(j) + len(lines[j]) - len(after) if after else 0))
    return out


def _compound(a: str, b: str) -> str:
    return f"{skeleton(a)}-{skeleton(b)}"


def _specks(t: Tokens) -> Iterator[tuple[int, int, int]]:
    """(text, start, end) of signs that stand alone and have no business there."""
    white = _tables()["white"][t.cp]
    start, end = kernel.runs(~white)
    plain = np.concatenate([[0], np.cumsum(_tables()["plain"][t.cp])])
    for i in np.flatnonzero((end - start <= 3) & (plain[end] == plain[start])).tolist():
        s = t.cp[start[i] : end[i]].tobytes().decode("utf-32-le", "surrogatepass")
        if set(s) <= _ALONE or s in _PLAIN:
            continue
        yield int(np.searchsorted(t.begin, start[i], side="right")) - 1, int(start[i]), int(end[i])


def _copies(blocks: DataFrame) -> DataFrame:
    """block, i: the places in their blocks of all but one of equal copies."""
    each = blocks.where(F.exists("shares", lambda x: x < 1)).select("block", F.posexplode(F.arrays_zip("books", "nums", "shares")).alias("i", "x")).where("x.shares < 1")
    order = Window.partitionBy("x.books", "x.nums").orderBy("block", "i")
    return each.withColumn("n", F.row_number().over(order)).where("n > 1").select("block", "i")


# --- Counting words, learning what stands and what is misread


def name_contexts(totals: DataFrame) -> DataFrame:
    """word: what names follow. ``totals``: word, uses, rare, as ``token_blocks`` counts them, over the corpus.

    Names are an open class: nearly all that follows an honorific is rare where it stands, while what
    follows any other word is mostly frequent. So a word is a name's context if at least half of its
    uses, and ``OPEN`` times as many as with words in general, have a rare word after it.
    """
    overall = totals.where("NOT contains(word, '-')").agg((F.sum("rare") / F.sum("uses")).alias("share"))
    found = totals.where(F.col("uses") >= LEAST_CONTEXT).crossJoin(F.broadcast(overall))
    return found.where(F.col("rare") >= F.col("uses") * F.greatest(F.lit(0.5), F.col("share") * OPEN)).select("word")


def misreadings(counts: DataFrame) -> DataFrame:
    """bones, word, uses, meant, standing: words that are no names, by skeleton.

    ``standing`` words have over 1/``RATIO`` of the uses of the most used form; the others are
    misreadings, of that form (``meant``) unless their context says otherwise.
    """
    words = counts.where("NOT contains(word, '-') AND length(word) > 1 AND NOT name").withColumn("bones", skeletons(F.col("word")))
    best = F.max(F.struct("uses", "word")).over(Window.partitionBy("bones"))
    ranked = words.select("bones", "word", "uses", best.alias("best")).where(F.col("best.uses") >= FREQUENT)
    return ranked.select("bones", "word", "uses", F.col("best.word").alias("meant"), (F.col("uses") * RATIO > F.col("best.uses")).alias("standing"))


def _grams(name: Column) -> Column:
    """The trigrams of a name with a space at either end."""
    return F.transform(F.sequence(F.lit(1), F.length(name)), lambda i: F.substr(F.concat(F.lit(" "), name, F.lit(" ")), i, F.lit(3)))


def _variants(name: str) -> list[tuple[int, str]]:
    """(order, the name with one glyph put right), for every glyph that may be misread."""
    out = []
    for read, meant in CONFUSED:
        for one in ([meant] if len(read) > 1 else [m for m in (meant, "l", "а", "о") if m != read]):
            at = name.find(read)
            while at >= 0:
                out.append((len(out), name[:at] + one + name[at + len(read) :]))
                at = name.find(read, at + 1)
    return out


def _varied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 2_000):
            rows = [(w, i, v) for w in batch.column(0).slice(a, 2_000).to_pylist() for i, v in _variants(w)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.string()))], ["word", "i", "variant"])


def misread_names(counts: DataFrame) -> DataFrame:
    """word, meant: names whose rarest trigram becomes a common one when one glyph is put right."""
    names = counts.where("name AND length(word) > 3").select("word", "uses")
    table = stage(names.select(F.explode(_grams(F.col("word"))).alias("g"), "uses").groupBy("g").agg(F.sum("uses").alias("n")), "trigrams")
    low = table.agg(F.greatest(F.lit(1.0), F.sum("n") / 40_000).alias("low"))
    least = lambda rows, keys: rows.join(table, "g", "left").groupBy(*keys).agg(F.min(F.coalesce("n", F.lit(0.0))).alias("least")).crossJoin(F.broadcast(low))
    doubtful = least(names.select("word", F.explode(_grams(F.col("word"))).alias("g")), ["word"]).where("least <= low").select("word")
    doubtful = stage(doubtful, "doubtful")
    each = doubtful.mapInArrow(_varied, "word string, i int, variant string")
    right = least(each.select("word", "i", "variant", F.explode(_grams(F.col("variant"))).alias("g")), ["word", "i", "variant"]).where("least > 8 * low")
    return right.groupBy("word").agg(F.max_by("variant", F.struct("least", -F.col("i"))).alias("meant"))


# --- Each block's own lexicon

_WRONG, _NAME, _COMPOUND, _CONTEXT, _CHOICE, _AMBIGUOUS = range(6)


class Block:
    """A block's tokens, as a row of ``token_blocks`` has them."""

    def __init__(self, words: list[str], numbers: bytes, flags: bytes, counts: bytes):
        self.words, self.number, self.flags = words, _wide(numbers), np.frombuffer(flags, np.uint8)
        self.page = np.repeat(np.arange(len(_wide(counts))), _wide(counts))
        self.close = (self.flags & _CLOSE) > 0
        self.index = {w: i for i, w in enumerate(words)}

    def listed(self, words: list[str]) -> np.ndarray:
        """Which of the distinct tokens are among ``words``."""
        mask = np.zeros(len(self.words) + 1, bool)
        mask[[self.index[w] for w in words if w in self.index]] = True
        return mask

    def placed(self, places: bytes, gaps: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The line and the first character of each token within its page."""
        return _sums(places, np.zeros(len(self.number), np.int64), self.page), _sums(gaps, _lengths(self.words)[self.number], self.page)

    def before(self) -> np.ndarray:
        """The number of the token close before each token; one past the last number without one."""
        out = np.full(len(self.number), len(self.words))
        out[1:] = np.where(self.close[1:], self.number[:-1], len(self.words))
        return out


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block: the words after a listed word, and how often."""
    for batch in batches:
        for k in range(batch.num_rows):
            shares, words, numbers, flags, counts, wanted = (batch.column(i)[k].as_py() for i in range(6))
            own = Block(words, numbers, flags, counts)
            at = np.flatnonzero(own.listed(wanted)[own.before()] & ((own.flags & (_WORD | _CUTS | _REST)) == _WORD)) if len(own.number) else np.empty(0, np.int64)
            n = np.bincount(own.number[at], np.array(shares)[own.page[at]], len(words))
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([words[i] for i in some], pa.string()), pa.array(n[some], pa.float64())], ["word", "named"])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block: each listed word with the words close before it, and how often."""
    for batch in batches:
        for k in range(batch.num_rows):
            block, shares, words, numbers, flags, counts, wanted = (batch.column(i)[k].as_py() for i in range(7))
            own = Block(words, numbers, flags, counts)
            before = own.before()
            at = np.flatnonzero(own.listed(wanted)[own.number] & (before < len(words)) & ((own.flags & _WORD) > 0))
            _, first, which = np.unique(before[at] * len(words) + own.number[at], return_index=True, return_inverse=True)
            n = np.bincount(which, np.array(shares)[own.page[at]], len(first))
            first = at[first]
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(first), pa.int64()), *[pa.array([words[i] for i in x[first]], pa.string()) for x in (before, own.number)], pa.array(n, pa.float64())], ["block", "before", "word", "n"])


def choices(pairs: DataFrame, forms: DataFrame) -> DataFrame:
    """before, word, meant: what a form means after a word, chosen among the standing forms of its skeleton.

    A misreading means the standing form that follows the word before it most often. A standing
    form is itself misread where another one follows that word ``RATIO`` times as often, and
    ``FREQUENT`` times at least: its neighbours don't support it.
    """
    by = pairs.groupBy("before", "word").agg(F.sum("n").alias("n")).join(forms.select("bones", "word", "meant", "standing"), "word")
    best = by.where("standing").groupBy("before", "bones").agg(F.max(F.struct("n", "word")).alias("best"))
    both = by.join(best, ["before", "bones"]).where(F.col("word") != F.col("best.word"))
    unsupported = (F.col("best.n") >= FREQUENT) & (F.col("best.n") >= F.col("n") * RATIO)
    return both.where((~F.col("standing") & (F.col("best.word") != F.col("meant"))) | (F.col("standing") & unsupported)).select("before", "word", F.col("best.word").alias("meant"))


def _found_in(words: DataFrame, table: DataFrame, salts: int) -> DataFrame:
    """The rows of ``table`` for each block that has the word. A word's blocks are spread over ``salts`` keys."""
    if salts == 1:
        return words.join(table, "word")
    spread = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return words.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int")).join(spread, ["word", "salt"]).drop("salt")


def lexicons(blocks: DataFrame) -> DataFrame:
    """block, entries: what each block's own words are and may mean.

    All that is known of words goes into one table, which is joined with the words of the blocks once; a
    block gets entries of its own words only, so neither the driver nor a task holds the lexicon of
    the corpus.
    """
    own = blocks.select("block", F.explode(F.concat("words", "asked")).alias("word"))
    salts = 1 + blocks.select("block").count() // MOST_BLOCKS
    asked = blocks.select(F.explode("asked").alias("word"), F.lit(0.0).alias("uses"), F.lit(0.0).alias("rare"))
    totals = stage(blocks.select(F.explode("uses").alias("u")).select("u.*").unionByName(asked).groupBy("word").agg(F.sum("uses").alias("uses"), F.sum("rare").alias("rare")), "totals")
    contexts = stage(name_contexts(totals), "contexts")
    tokens = ("words", "numbers", "flags", "counts")
    listed = lambda found: stage(found.groupBy("block").agg(F.collect_set("word").alias("wanted")), "listed")
    named = blocks.select("block", "shares", *tokens).join(listed(_found_in(own, contexts, salts)).hint("merge"), "block").drop("block").mapInArrow(_named, "word string, named double")
    named = named.groupBy("word").agg(F.sum("named").alias("named"))
    counts = stage(totals.join(named, "word", "left").select("word", "uses", F.coalesce(F.col("named") * 2 >= F.col("uses"), F.lit(False)).alias("name")), "counts")
    forms = stage(misreadings(counts), "forms")
    ambiguous = forms.groupBy("bones").agg(F.count_if("standing").alias("n")).where("n > 1").select("bones")
    none = F.lit(None).cast("string")
    kind = lambda df, k, meant=none: df.select("word", F.lit(k).alias("kind"), meant.alias("meant"))
    known = [
        kind(forms.where("NOT standing"), _WRONG, F.col("meant")), kind(misread_names(counts), _NAME, F.col("meant")), kind(counts.where(F.col("word").contains("-") & (F.col("uses") >= COMPOUND)), _COMPOUND), kind(contexts, _CONTEXT),
        kind(forms.join(ambiguous, "bones", "left_semi"), _AMBIGUOUS),
    ]
    found = stage(_found_in(own, stage(functools.reduce(DataFrame.unionByName, known), "lexicon"), salts), "found")
    pairs = blocks.select("block", "shares", *tokens).join(listed(found.where(F.col("kind") == _AMBIGUOUS)).hint("merge"), "block")
    pairs = stage(pairs.mapInArrow(_pairs, "block long, before string, word string, n double"), "pairs")
    chosen = pairs.select("block", "before", "word").join(choices(pairs, forms), ["before", "word"]).withColumn("kind", F.lit(_CHOICE))
    entries = found.where(F.col("kind") != _AMBIGUOUS).unionByName(chosen, allowMissingColumns=True)
    return stage(entries.groupBy("block").agg(F.collect_list(F.struct("kind", "word", "before", "meant")).alias("entries")), "entries")


# --- Lines at the edges of pages


def page_number(line: str) -> bool:
    """Whether the line holds only a page number, in whatever dress."""
    s = line.strip()
    if not s or len(s) > 24 or s[-1] in ".)؟?۔":
        return False
    m = _NUMBER.match(_DRESS.match(s).group(1))
    if not m:
        return False
    label, n = m["label"], m["n"]
    if label is None:
        # A bare roman numeral must be a well-formed one; letters among digits are misread digits.
        return any(c.isdigit() for c in n) or n in ("l", "I", "O", "lO", "ll") or bool(re.fullmatch(r"(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})", n))
    return skeleton(label.lower()) in _LABEL_BONES


_LABEL_BONES = {skeleton(x) for x in LABELS}


def masked(line: str) -> str:
    """A header's key: letters only, lower case, as a skeleton; digits and dress are dropped."""
    return skeleton("".join(c for c in line.lower() if c.isalpha()))


def _title_like(s: str) -> bool:
    """Whether the line may be a title: few words, and the first one with case is capitalised."""
    words = re.findall(r"[^\W\d_]\S*", s)
    cased = [w for w in words if w[0].lower() != w[0].upper()]
    return 0 < len(words) <= 9 and (not cased or cased[0][0].isupper())


def edges(lines: list[str]) -> list[tuple[int, str, str]]:
    """(line, kind, key) of the page numbers and possible headers.

    From each end lines are taken as long as they may be page numbers or headers. Kinds: page_number,
    header (by its dress: dashes, an attached number), header? (by its shape: it has no end of a
    sentence, and what follows or comes before is a whole paragraph), header?? (only if other pages or
    the title say so), header??? (long lines, only if the title says so).
    """
    filled = [i for i, x in enumerate(lines) if x and not x.isspace()]
    if not filled:
        return []
    width = max(len(lines[i].strip()) for i in filled)
    found: dict[int, tuple[str, str]] = {}
    for order, step in ((filled, 1), (filled[::-1], -1)):
        beyond = False
        for k, i in enumerate(order):
            s = lines[i].strip()
            if i in found:
                continue
            if k > 1 and beyond:
                break
            if page_number(s):
                found[i] = ("page_number", "")
                continue
            if beyond or not any(c.isalpha() for c in s):
                beyond = True  # only a page number may still follow
                continue
            m = _WITH_NUMBER.match(s)
            long = len(s) > 80 or len(s.split()) > 12
            dashed = len(s) > 4 and s[0] in "—–-" and s[-1] in "—–-"
            core = (m["a"] or m["b"]).strip() if m else s.strip("—–- ") if dashed else s
            if (m or dashed) and not long and core and core[-1] not in ").":
                found[i] = ("header", masked(core))
                continue
            beyond = True
            if s[-1] in _ENDS and not (s[-1] in ".'" and len(s) < 0.8 * width):
                continue
            if len(order) > k + 1:
                j = order[k + 1]
                other = lines[j].strip()
                if step == 1 and not page_number(other) and abs(j - i) == 1:
                    # A line of running text would have taken the next line's first word.
                    if len(s) + 1 + len(other.split()[0]) > width or other[0].islower():
                        continue
                if step == -1 and not page_number(other) and other[-1] not in _ENDS:
                    continue
            # Signs of a sentence inside, many words, or a place further inside ask for support by other pages or
            # the title. So does a last line, as a page's text may break off.
            doubtful = not _title_like(s) or s[-1] in _ENDS or len(s.split()) > 7 or bool(_INSIDE.search(s)) or (step == -1 and k == 0) or k > 1
            found[i] = ("header???" if long else "header??" if doubtful else "header?", masked(core))
            beyond = False
    return [(i, kind, key) for i, (kind, key) in found.items()]


# --- Marking lines


def marked(block: Block, places: np.ndarray, starts: np.ndarray, cuts: list[dict], entries: list[dict]) -> list[tuple]:
    """(page, line, kind, start, size, word): what the lexicon says of a block.

    Kinds: misread and hyphen are noise; joined says that a line ends inside a word whose hyphen is its
    own; fix says what stands instead of so many characters.
    """
    kinds: dict[int, list[dict]] = {k: [] for k in range(5)}
    for e in entries:
        kinds[e["kind"]].append(e)
    words, names = ({e["word"]: e["meant"] for e in kinds[k]} for k in (_WRONG, _NAME))
    compounds = {e["word"] for e in kinds[_COMPOUND]}
    other = {(e["before"], e["word"]): e["meant"] for e in kinds[_CHOICE]}
    flag = lambda bit: (block.flags & bit) > 0
    before = block.before()
    named = block.listed([e["word"] for e in kinds[_CONTEXT]])[before] if len(before) else np.empty(0, bool)
    width = len(block.words) + 1
    pairs = np.array(sorted(block.index[b] * width + block.index[w] for b, w in other if b in block.index and w in block.index), np.int64)
    wrong = block.listed(list(words))[block.number] | _within(before * width + block.number, pairs)
    wrong = (wrong & flag(_WORD) & ~named & ~flag(_CUTS) & ~flag(_REST)) | (named & block.listed(list(names))[block.number] & ~flag(_CUTS))
    out: list[tuple] = []
    lines: set[tuple[int, int]] = set()
    sure = flag(_SURE)
    for i in np.flatnonzero(wrong).tolist():
        page, line, word = int(block.page[i]), int(places[i]), block.words[block.number[i]]
        prior = block.words[before[i]] if before[i] < len(block.words) else None
        meant = names[word] if named[i] else other.get((prior, word)) or words[word]
        out.append((page, line, "fix", int(starts[i]), len(word) - word.count("i\u0307"), meant))
        if not sure[i]:
            lines.add((page, line))
    for c in cuts:
        a, b = c["a"], c["b"]
        # A hyphen at the end of a page may belong to the word; other marks never do.
        noise = not c["hyphen"] or bool(a and b and skeleton(a) != skeleton(b) and _compound(a, b) not in compounds)
        out.append((c["i"], c["line"], "hyphen" if noise else "joined", None, None, None))
        if not a or not b:
            continue
        meant = words.get(a + b) or names.get(a + b)
        odd = [k for k, x in enumerate(a + b) if x in "013569@" and k]
        if meant is None and not (odd and any(x.isalpha() for x in a + b)):
            continue
        at = odd[0] if odd else next((k for k, (x, y) in enumerate(zip(a + b, meant)) if x != y), len(a + b) - 1)
        lines.add((c["i"], c["line"] if at < len(a) else c["next"]))
        if meant and noise:
            out += [(c["i"], c["line"], "fix", c["at"], len(a), meant[: len(a)]), (c["i"], c["next"], "fix", c["to"], len(b), meant[len(a) :])]
    return out + [(page, line, "misread", None, None, None) for page, line in sorted(lines)]


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            get = lambda name: batch.column(name)[k]  # noqa: B023, E731
            block = Block(*[get(c).as_py() for c in ("words", "numbers", "flags", "counts")])
            found = marked(block, *block.placed(get("places").as_py(), get("gaps").as_py()), get("cuts").as_py(), get("entries").as_py() or [])
            page = np.array([r[0] for r in found], np.int64)
            keys = [get(c).values.take(pa.array(page)) for c in ("books", "nums")]
            kinds = (pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([get("block").as_py()] * len(page), pa.int64()), pa.array(page.astype(np.int32)), *keys, *[pa.array([r[i + 1] for r in found], t) for i, t in enumerate(kinds)]], ["block", "i", "book_id", "page_num", "line", "kind", "start", "size", "word"])


def candidate_lines(blocks: DataFrame) -> DataFrame:
    """block, i, book_id, page_num, line_num, kind, key, start, size, word: all that is said of lines; headers are not yet decided."""
    kind = blocks.schema["nums"].dataType.elementType.simpleString()
    # The tokens of a block meet its entries in a join on the block. It is a shuffle at every size, as entries grow with the pages.
    both = blocks.drop("shares", "uses", "asked", "lines").join(lexicons(blocks).hint("merge"), "block", "left")
    marks = both.mapInArrow(_mark, f"block long, i int, book_id string, page_num {kind}, line int, kind string, start int, size int, word string")
    own = blocks.select("block", "books", "nums", F.explode("lines").alias("x")).select("block", "x.i", F.get("books", F.col("x.i")).alias("book_id"), F.get("nums", F.col("x.i")).alias("page_num"), "x.line", "x.kind", "x.key", "x.start", "x.size")
    every = marks.unionByName(own, allowMissingColumns=True).join(_copies(blocks), ["block", "i"], "left_anti")
    return every.select((F.col("block") + F.col("i")).alias("pid"), "book_id", "page_num", (F.col("line") + 1).alias("line_num"), "kind", "key", "start", "size", "word")


@functools.lru_cache(None)
def _segments(length: int) -> list[tuple[int, int]]:
    """(start, end) of the parts of a header's key: one more than the letters in which it may differ."""
    n = NEAR + 1 if length >= SHORT_HEADER else 2
    size, more = divmod(length, n)
    ends = np.cumsum([size + (i >= n - more) for i in range(n)]).tolist()
    return list(zip([0, *ends[:-1]], ends))


class _Parts:
    """Keys by their parts, to find those that nearly are another key.

    There is one part more than there may be changes, so one at least is left as it is, near its own
    place; a part is looked up only at places that the changes before and after it allow.
    """

    def __init__(self) -> None:
        self.by: dict[tuple[int, int, str], list[str]] = {}
        self.lengths: set[int] = set()

    def add(self, key: str) -> None:
        if len(key) > 1:
            self.lengths.add(len(key))
            for i, (a, b) in enumerate(_segments(len(key))):
                self.by.setdefault((len(key), i, key[a:b]), []).append(key)

    def like(self, key: str) -> set[str]:
        found: set[str] = set()
        for n in self.lengths:
            near = NEAR if n >= SHORT_HEADER else 1
            more = len(key) - n
            if abs(more) > near:
                continue
            for i, (a, b) in enumerate(_segments(n)):
                for at in range(max(0, a - i, a + more - near + i), min(len(key) - b + a, a + i, a + more + near - i) + 1):
                    found.update(self.by.get((n, i, key[at : at + b - a]), ()))
        return found


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (book, row, column, side, key), sorted, strong keys before weak ones: the pairs that may be near."""
    cell, parts = None, _Parts()
    for batch in batches:
        out = []
        for book, row, column, side, key in zip(*[c.to_pylist() for c in batch.columns]):
            if (book, row, column) != cell:
                cell, parts = (book, row, column), _Parts()
            if side == 0:
                parts.add(key)
            else:
                out += [(book, key, x) for x in parts.like(key)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string()) for i in range(3)], ["book_id", "key", "like"])


def near_headers(weak: DataFrame, strong: DataFrame) -> DataFrame:
    """book_id, key: the keys of ``weak`` that nearly are one of ``strong`` in the same book.

    A book's keys are compared by their parts, in cells of ``CELL`` keys of either side: all of a book but a
    very large one.
    """
    count = lambda df, name: df.groupBy("book_id").agg((1 + F.floor(F.count("*") / CELL)).cast("int").alias(name))
    grid = stage(count(weak, "rows").join(count(strong, "columns"), "book_id"), "header-grid")
    place = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = weak.join(grid, "book_id").select("book_id", place("rows").alias("row"), every("columns").alias("column"), F.lit(1).alias("side"), "key")
    b = strong.join(grid, "book_id").select("book_id", every("rows").alias("row"), place("columns").alias("column"), F.lit(0).alias("side"), "key")
    cells = a.unionByName(b).repartition("book_id", "row", "column").sortWithinPartitions("book_id", "row", "column", "side")
    pairs = cells.mapInArrow(_alike, "book_id string, key string, like string")
    most = F.when(F.length("like") >= SHORT_HEADER, NEAR).otherwise(1)
    return pairs.where(F.levenshtein("key", "like") <= most).select("book_id", "key").distinct()


def _decided(found: DataFrame, pages: DataFrame, books: DataFrame) -> DataFrame:
    """``found`` with its possible headers decided: those that are none are gone, and so is what else is said of headers' lines."""
    first = pages.groupBy("book_id").agg(F.min("page_num").alias("first")).withColumnRenamed("book_id", "b")
    titles = current_rows(books.select("book_id", "title", "updated_at"), ["book_id"]).select(F.col("book_id").alias("b"), skeletons(F.regexp_replace(F.lower("title"), r"\P{L}+", "")).alias("title"))
    heads = found.where("kind LIKE 'header%'").select("pid", "book_id", "page_num", "line_num", "kind", "key")
    # Headers are few, and looked at from several sides; written once, they are not computed again.
    heads = stage(heads.join(first, F.col("book_id") == F.col("b"), "left").drop("b").where("page_num > first"), "heads")
    uses = stage(heads.groupBy("book_id", "key").agg(F.count_distinct("page_num").alias("n"), F.bool_or(F.col("kind") == "header??").alias("weak")), "header-keys")
    alike = stage(near_headers(uses.where("weak").select("book_id", "key"), uses.where("n > 1").select("book_id", "key")).withColumn("alike", F.lit(True)), "near-headers")
    heads = heads.join(uses.drop("weak"), ["book_id", "key"]).join(alike, ["book_id", "key"], "left").join(titles, F.col("book_id") == F.col("b"), "left").drop("b")
    near = (F.levenshtein(F.col("key"), F.coalesce("title", F.lit("")), NEAR) >= 0) | ((F.length("title") > 5) & (F.col("key").startswith(F.col("title")) | F.col("title").startswith(F.col("key"))) & (F.length("key") > 5))
    near = F.coalesce(near, F.lit(False))
    support = (F.col("n") > 1) | F.coalesce("alike", F.lit(False)) | near
    # A shape that alone says header is enough; one that ends like a sentence needs support.
    sure = heads.where((F.col("kind").isin("header", "header?")) | (support & (F.col("kind") == "header??")) | near).select("pid", "book_id", "page_num", "line_num", F.lit("header").alias("kind"))
    rest = found.where("kind NOT LIKE 'header%'").join(sure.select("pid", "line_num"), ["pid", "line_num"], "left_anti")
    return rest.drop("key").unionByName(sure, allowMissingColumns=True)


def noisy_lines(pages: DataFrame, books: DataFrame) -> DataFrame:
    """book_id, page_num, line_num, kind: every noisy line of every current page."""
    found = stage(candidate_lines(token_blocks(pages)), "lines")
    noise = found.where("kind LIKE 'header%' OR kind IN ('page_number', 'hyphen', 'misread')").drop("start", "size", "word")
    # The same line may be misread in several ways.
    noise = noise.where("kind <> 'misread'").unionByName(noise.where("kind = 'misread'").dropDuplicates(["pid", "line_num"]))
    return _decided(noise, pages, books).select("book_id", "page_num", "line_num", "kind")


# --- Repair


def _like(word: Column, model: Column) -> Column:
    """The word in the case of ``model``."""
    loud = (F.upper(model) == model) & (F.lower(model) != model) & (F.regexp_count(model, F.lit(r"\p{L}")) > 1)
    head = F.left(model, F.lit(1))
    return F.when(loud, F.upper(word)).when(F.lower(head) != head, F.concat(F.upper(F.left(word, F.lit(1))), F.substr(word, F.lit(2)))).otherwise(word)


def righted(content: Column, fixes: Column) -> Column:
    """The text with so many characters replaced at each place; ``fixes``: (start from 0, size, word), the last places first.

    Where nothing stands instead (specks), the space after it goes too.
    """

    def one(text: Column, fix: Column) -> Column:
        at, size = fix["start"] + 1, fix["size"]
        model = F.substr(text, at, size)
        speck = fix["word"] == ""
        return F.overlay(text, _like(fix["word"], model), at, F.when(speck & (F.substr(text, at + size, F.lit(1)) == " "), size + 1).otherwise(size))

    return F.aggregate(F.coalesce(fixes, F.array().cast("array<struct<start:int,size:int,word:string>>")), content, one)


def reflowed(lines: DataFrame, key: str, carried: tuple[str, ...] = ()) -> DataFrame:
    """key, carried columns, content: the lines of each page as paragraphs, by windows over its lines.

    ``lines``: key, line_num, line, gone (a header or page number), indented, glued (it ends inside a word). A
    paragraph begins after a blank line, with an indented line, and after a line that ends a sentence
    and is much shorter than the page's longest.
    """
    page = Window.partitionBy(key)
    order = page.orderBy("line_num")
    rows = lines.withColumns({"n": F.sum((~F.col("gone")).cast("int")).over(order), "width": F.max(F.when(~F.col("gone"), F.length("line"))).over(page), "kept": ~F.col("gone") & (F.col("line") != "")})
    last = F.last(F.when(F.col("kept"), F.struct("line", "glued", "n")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("last", last)
    ended = F.right("last.line", F.lit(1)).isin(*".!?؟۔") & (F.length("last.line") < 0.75 * F.col("width"))
    glue = F.when(F.col("last").isNull() | F.col("last.glued"), "").when((F.col("n") - F.col("last.n") > 1) | F.col("indented") | ended, "\n\n").otherwise(" ")
    piece = F.when(F.col("kept"), F.struct("line_num", F.concat(glue, "line").alias("line")))
    return rows.select(key, *carried, piece.alias("piece")).groupBy(key).agg(*[F.first(c).alias(c) for c in carried], F.array_join(F.transform(F.array_sort(F.collect_list("piece")), lambda x: x["line"]), "").alias("content"))


def repaired_pages(pages: DataFrame, books: DataFrame) -> DataFrame:
    """book_id, page_num, content, content_len: every current page as continuous paragraphs.

    The contents are shuffled once, by page; notes on their lines are joined to them there.
    """
    said = _decided(stage(candidate_lines(token_blocks(pages)), "lines"), pages, books)
    key = F.concat_ws(":", F.coalesce(F.concat(F.lit("b"), F.col("book_id")), F.lit("")), F.coalesce(F.col("page_num").cast("string"), F.lit(""))).alias("page")
    fix = F.when(F.col("kind").isin("fix", "speck"), F.struct("start", "size", F.coalesce("word", F.lit("")).alias("word")))
    those = lambda *kinds: F.collect_set(F.when(F.col("kind").isin(*kinds), F.col("line_num")))
    notes = said.where("kind <> 'misread'").groupBy(key).agg(F.sort_array(F.collect_set(fix), asc=False).alias("fixes"), those("header", "page_number").alias("gone"), those("hyphen", "joined").alias("glued"), those("hyphen").alias("marked"))
    rows = current_rows(pages.select("book_id", "page_num", F.col("content").cast("string").alias("content"), "updated_at", key), ["page"]).drop("updated_at")
    rows = rows.join(notes, "page", "left").withColumn("content", righted(F.coalesce("content", F.lit("")), F.col("fixes")))
    rows = rows.select(F.struct("page", "book_id", "page_num").alias("id"), "page", "gone", "glued", "marked", F.posexplode(F.split("content", "\n", -1)).alias("pos", "raw"))
    within = lambda c: F.coalesce(F.array_contains(c, F.col("pos") + 1), F.lit(False))
    line = strip(F.col("raw"))
    lines = rows.select("page", "id", (F.col("pos") + 1).alias("line_num"), F.when(within("marked"), F.left(line, F.length(line) - 1)).otherwise(line).alias("line"), within("gone").alias("gone"), within("glued").alias("glued"), F.col("raw").rlike("^[ \t]").alias("indented"))
    # Every line carries its page's own keys.
    return reflowed(lines, "page", ("id",)).select("id.book_id", "id.page_num", "content", F.length("content").alias("content_len"))
