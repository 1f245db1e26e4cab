"""One consistent form for texts that look alike but differ in their characters.

The form is computed by DuckDB inside Arrow partitions: invisible characters and kinds of blanks by
regular expressions, width forms, joined and look-alike letters by translate, accents by
nfc_normalize. What a reader can tell apart stays apart: digits, letter case, accents and raised or
lowered signs are never folded.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.runtime import cut

#: Letters and signs that are drawn like the one they follow.
LOOKALIKES = {
    "A": "АΑᎪ", "B": "ВΒᏴ", "C": "СϹⅭ", "D": "Ⅾ", "E": "ЕΕ", "F": "Ϝ", "G": "Ԍ", "H": "НΗ", "I": "ІΙӀⅠ", "J": "ЈͿ",
    "K": "КΚK", "L": "Ⅼ", "M": "МΜϺⅯ", "N": "Ν", "O": "ОΟՕ", "P": "РΡ", "Q": "Ԛ", "S": "ЅՏ", "T": "ТΤ", "V": "ѴⅤ", "W": "Ԝ",
    "X": "ХΧⅩ", "Y": "ΥҮ", "Z": "Ζ",
    "a": "аɑ", "c": "сϲⅽ", "d": "ԁⅾ", "e": "е", "g": "ɡց", "h": "һհ", "i": "іⅰ", "j": "јϳ", "l": "ⅼӏ", "m": "ⅿ", "n": "ո",
    "o": "оοօ", "p": "рρ", "q": "ԛզ", "s": "ѕ", "u": "սʋ", "v": "νѵⅴ", "w": "ԝ", "x": "хⅹ", "y": "уү",
    "Å": "Å", "Ω": "Ω", "μ": "µ", "Ɛ": "Ԑ", "ə": "ә", "Ə": "Ә", "æ": "ӕ", "Æ": "Ӕ", "Г": "Γ", "П": "Π", "Ф": "Φ", "к": "ĸ", "ʼ": "ʹ",
    "-": "‐‑‒−﹣⁃˗", ":": "։∶", ";": ";", "·": "·", "…": "⋯", "'": "ʼ", "!": "ǃ", "|": "ǀ∣", "/": "⁄∕", "*": "∗", "~": "∼", "<": "‹˂", ">": "›˃",
}
#: Letters of Lisu, Cherokee and Coptic that are drawn like the Latin ones they follow.
OTHER_SCRIPTS = {
    "A": "ꓮⲀ", "B": "ꓐⲂ", "C": "ꓚᏟⲤ", "D": "ꓓᎠ", "E": "ꓰᎬ", "F": "ꓝ", "G": "ꓖᏀ", "H": "ꓧᎻⲎ", "I": "ꓲⲒ", "J": "ꓙᎫ", "K": "ꓗᏦⲔ", "L": "ꓡᏞ", "M": "ꓟᎷⲘ",
    "N": "ꓠⲚ", "O": "ꓳⲞ", "P": "ꓑᏢⲢ", "R": "ꓣᏒ", "S": "ꓢᏚ", "T": "ꓔᎢⲦ", "U": "ꓴՍ", "V": "ꓦᏙ", "W": "ꓪᎳ", "X": "ꓫⲬ", "Y": "ꓬᎽⲨ", "Z": "ꓜᏃⲌ",
    "c": "ⲥ", "o": "ⲟ", "p": "ⲣ", ".": "ꓸ․", ",": "ꓹ‚",
}
#: Joined letters and what they join.
JOINED = {
    "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "ſt", "ﬆ": "st", "Ĳ": "IJ", "ĳ": "ij", "Ǉ": "LJ", "ǈ": "Lj", "ǉ": "lj",
    "Ǌ": "NJ", "ǋ": "Nj", "ǌ": "nj", "Ǳ": "DZ", "ǲ": "Dz", "ǳ": "dz", "Ǆ": "DŽ", "ǅ": "Dž", "ǆ": "dž", "ﬓ": "մն", "ﬔ": "մե", "ﬕ": "մի", "ﬖ": "վն", "ﬗ": "մխ",
    "Ⅱ": "II", "Ⅲ": "III", "Ⅳ": "IV", "Ⅵ": "VI", "Ⅶ": "VII", "Ⅷ": "VIII", "Ⅸ": "IX", "Ⅺ": "XI", "Ⅻ": "XII",
    "ⅱ": "ii", "ⅲ": "iii", "ⅳ": "iv", "ⅵ": "vi", "ⅶ": "vii", "ⅷ": "viii", "ⅸ": "ix", "ⅺ": "xi", "ⅻ": "xii", "‥": "..", "…": "...", "⋯": "...",
    "㍉": "ミリ", "㌔": "キロ", "㍑": "リットル", "℡": "TEL", "№": "No", "㏄": "cc", "㎏": "kg", "㎜": "mm", "㎝": "cm", "㎞": "km",
}
#: Format characters that are drawn, such as the signs before numbers.
DRAWN = [*range(0x0600, 0x0606), 0x06DD, 0x070F, 0x0890, 0x0891, 0x08E2, 0x110BD, 0x110CD, *range(0x13430, 0x13456)]


def _invisible() -> str:
    """A class of the characters without a look: format controls but DRAWN, joiners, variation selectors, fillers."""
    codes = {c for c in range(0x110000) if unicodedata.category(chr(c)) == "Cf"} - set(DRAWN)
    codes |= {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, 0x7F}
    for low, high in ((0x180B, 0x180F), (0xFE00, 0xFE0F), (0xE0100, 0xE01EF), (0x00, 0x08), (0x0E, 0x1F)):
        codes |= set(range(low, high + 1))
    spans: list[list[int]] = []
    for c in sorted(codes):
        if spans and spans[-1][1] == c - 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    return "[" + "".join(f"\\x{{{low:04X}}}-\\x{{{high:04X}}}" for low, high in spans) + "]+"


#: Every blank but the line feed; several in a row look like one wider one and count as one.
BLANKS = r"[\p{Zs}\t\x{000B}\x{000C}]+"


@functools.cache
def letter_map() -> tuple[str, str]:
    """The two arguments of translate: width forms by rule, look-alikes, and their accented forms."""
    table: dict[str, str] = {}
    for code in [*range(0xFF01, 0xFFEF), *range(0x3131, 0x3190)]:
        char = chr(code)
        if unicodedata.decomposition(char).startswith(("<wide>", "<narrow>")):
            wide = unicodedata.normalize("NFKC", char) if code < 0xFF9E or code > 0xFF9F else chr(0x3099 + code - 0xFF9E)
            if len(wide) == 1:
                table[char] = wide
    base = {old: new for letters in (LOOKALIKES, OTHER_SCRIPTS) for new, olds in letters.items() for old in olds if old not in JOINED}
    table |= base
    table = {k: base.get(v, v) for k, v in table.items() if k not in JOINED}
    for code in range(0xC0, 0x2000):  # an accented look-alike is the accented letter
        char = chr(code)
        parts = unicodedata.normalize("NFD", char)
        if len(parts) > 1 and parts[0] in base and char not in table:
            same = unicodedata.normalize("NFC", base[parts[0]] + parts[1:])
            if len(same) == 1 and same != char:
                table[char] = same
    return "".join(table), "".join(table.values())


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@functools.cache
def form_sql(column: str) -> str:
    """The consistent form of a column as a DuckDB expression."""
    old, new = letter_map()
    letters = lambda x: f"translate({x}, {_quoted(old)}, {_quoted(new)})"
    sql = f"regexp_replace({column}, '{_invisible()}', '', 'g')"
    for joined, apart in JOINED.items():
        sql = f"replace({sql}, {_quoted(joined)}, {_quoted(apart)})"
    sql = letters(f"nfc_normalize({letters(sql)})")
    sql = f"regexp_replace(regexp_replace({sql}, '\\r\\n?|\\x{{2028}}|\\x{{2029}}|\\x{{0085}}', chr(10), 'g'), '{BLANKS}', ' ', 'g')"
    return f"nfc_normalize(trim(regexp_replace({sql}, ' ?\\n ?', chr(10), 'g'), ' ' || chr(10)))"


def consistent(df: DataFrame, row_id: str, text: str, with_text: bool = True) -> DataFrame:
    """(row_id, form_key, text_key[, form]) of every row with a text.

    form_key and text_key are MD5 hashes of the consistent form and of the text; equal form_key and
    different text_key: same look, other characters. NULL texts have no look and give no row; an
    empty text has one, which texts of only invisible characters share.
    """
    kind = df.schema[row_id].dataType.simpleString()
    columns = "form_key, text_key" + ", form" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "600MB"})
        for batch in batches:
            con.register("batch", pa.Table.from_batches([batch]))
            form = f"SELECT {row_id}, md5({text}) AS text_key, {form_sql(text)} AS form FROM batch WHERE {text} IS NOT NULL"
            result = con.sql(f"SELECT {row_id}, md5(form) AS form_key, {columns[10:]} FROM ({form})").to_arrow_table()
            schema = pa.schema([batch.schema.field(0).with_name(row_id)] + [(c, pa.string()) for c in columns.split(", ")])
            yield from result.cast(schema).to_batches()
            con.unregister("batch")

    schema = f"{row_id} {kind}, " + ", ".join(f"{c} string" for c in columns.split(", "))
    return df.select(row_id, text).mapInArrow(run, schema)


def _alike(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """(row_id, form_key, text_key) of the rows whose look is that of several texts."""
    keys = cut(consistent(df, row_id, text, with_text=False))
    several = keys.groupBy("form_key").agg(F.min("text_key").alias("low"), F.max("text_key").alias("high")).where("low <> high").select("form_key")
    return cut(keys.join(several, "form_key", "left_semi"))


def alike_pairs(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """(id_a, id_b), id_a < id_b: rows whose texts look the same but are not the same characters.

    Distinct texts of a look pair first, then their rows are added, so that no pair is made that is
    not a result: exact copies never meet each other, however many there are.
    """
    alike = _alike(df, row_id, text)
    texts = alike.select("form_key", "text_key").distinct()
    a, b = (texts.select("form_key", F.col("text_key").alias(f"text_{x}")) for x in "ab")
    pairs = a.join(b, "form_key").where("text_a < text_b").drop("form_key")
    rows_a, rows_b = (alike.select(F.col("text_key").alias(f"text_{x}"), F.col(row_id).alias(f"row_{x}")) for x in "ab")
    both = pairs.join(rows_a, "text_a").join(rows_b, "text_b")
    return both.select(F.least("row_a", "row_b").alias("id_a"), F.greatest("row_a", "row_b").alias("id_b"))


def look_classes(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """(row_id, class_id): the smallest id among the rows of the same look."""
    return look_links(df, row_id, text).select(row_id, "class_id")


def look_links(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """(row_id, class_id, n_links) of every row with a text.

    class_id is the smallest id among the rows of the same look, n_links the number of rows of the
    same look but other characters. Counts are taken per text and look before they meet the rows, so
    a text of any number of copies is one row of the counts.
    """
    keys = cut(consistent(df, row_id, text, with_text=False))
    texts = cut(keys.groupBy("form_key", "text_key").agg(F.count("*").alias("n"), F.min(row_id).alias("first")))
    looks = texts.groupBy("form_key").agg(F.sum("n").alias("of_look"), F.min("first").alias("class_id"))
    known = texts.join(looks, "form_key").select("form_key", "text_key", "class_id", (F.col("of_look") - F.col("n")).alias("n_links"))
    return keys.join(known, ["form_key", "text_key"]).select(row_id, "class_id", "n_links")
