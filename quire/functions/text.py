"""Text functions as Column to Column expressions; built-in functions only. Patterns are Java's; `(?U)` makes classes Unicode."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..dims import STOP_WORDS

#: fixed values: number tokens and words
NUMBER = r"(?U)(?<![\w.])\d+(?:[.,]\d+)?(?![\w])"
WORD = "[A-Za-zÀ-ÿ]{2,}"
#: fixed values: captions anywhere and at the start of a line, symbols that an encoding lost, damaged characters, citations, vowels
CAPTION_WORDS = r"Table|Figure|Fig\.|Chart|Exhibit|Diagram|Tabla|Figura|Cuadro|Gr[aá]fic[ao]|Esquema"
BOX_WORDS = "Table|Tabla|Cuadro|Box|Recuadro|Panel|Exhibit"
CAPTION = rf"(?iU)\b({CAPTION_WORDS})\s*\d+(?:[.\-]\d+)?"
LINE_CAPTION = rf"(?imdU)^\s*(?:#+\s*)?(?:{BOX_WORDS})\s*[A-Z]?\d+(?:[.\-]\d+)?\b"
SYMBOL_LOSS = r"(?mdU)(?<![\w$#])[#$]\s?\d+(?:[.,]\d+)?\s?%|(?:(?<=[\s(\[])|^),\d|(?:(?<=[\s(\[])|^)\.\d{1,3},\d{3}\b|(?<!\S)##\s?\d"
BAD_CHARS = "[\ue000-\uf8ff\ufffd]"
CITATION = r"(?iU)\bet al\b|\bdoi\b|;\s*\d+\s*(?:\(\d+\))?\s*:\s*\d+"
VOWELS = "[aeiouyáéíóúüAEIOUYÁÉÍÓÚÜ]"
YEAR = r"(?U)\b(?:19|20)\d{2}\b"
#: fixed values: words of a block that is judged, shares of frequent words (too few; enough once shifted) and of words without vowels, damaged characters of a page
BLOCK_WORDS, STOP_SHARE, SHIFT_SHARE, MUTE_SHARE, BAD_COUNT = 8, 0.06, 0.15, 0.30, 3
#: fixed values: why a page is read as an image
DAMAGED, SYMBOLS, BOXED = "texto dañado", "símbolos perdidos", "tabla o recuadro"
LOWER = "abcdefghijklmnopqrstuvwxyz"
SHIFTS = (-1, 1, -2, 2, -3, 3)


#: white space of any kind, as Unicode has it, and the separators of information
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """White space of any kind goes at both ends."""
    return F.btrim(c, F.lit(WHITE))


def tidy(c: Column) -> Column:
    """Line ends become LF, blanks before them go, three or more become two, ends are stripped, one LF closes."""
    c = F.regexp_replace(c, r"\r\n?", "\n")
    c = F.regexp_replace(c, r"[ \t]+\n", "\n")
    return F.concat(strip(F.regexp_replace(c, r"\n{3,}", "\n\n")), F.lit("\n"))


def content_key(data: Column, kind: Column) -> Column:
    return F.sha1(F.concat(data.cast("binary"), kind.cast("binary")))


def token(key: Column) -> Column:
    return F.concat(F.lit("ZZOCRZZ"), F.substring(key, 1, 16), F.lit("ZZ"))


def slug(c: Column, most: int | None = 70, keep_hyphens: bool = True) -> Column:
    """Lower-case ASCII words joined by hyphens; cut after stripping; `libro` if nothing is left."""
    c = F.regexp_replace(F.lower(c), r"[^a-z0-9\-]+" if keep_hyphens else "[^a-z0-9]+", "-")
    c = F.regexp_replace(F.regexp_replace(c, "-{2,}", "-"), "^-+|-+$", "")
    c = F.substring(c, 1, most) if most else c
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("libro"))


def abbreviation(c: Column) -> Column:
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(F.upper(c), "[^A-Z0-9]", ""), 1, 6), F.lit("")), F.lit("BK"))


def numbers(c: Column) -> Column:
    """Number tokens that stand apart from word characters, with one decimal or group mark at most."""
    return F.regexp_extract_all(c, F.lit(NUMBER), F.lit(0))


def body_numbers(body: Column) -> Column:
    """Numbers of a body, each once in string order. Single digits, which stand everywhere, and those of lines of tags, sources, evidence and derived ones don't count."""
    own = F.filter(F.split(body, "\n"), lambda x: ~(x.rlike(r"(?iU)^\s*(?:tags|src|evidence):") | F.contains(x, F.lit("[DERIVED]"))))
    return F.array_sort(F.array_distinct(F.filter(numbers(F.array_join(own, "\n")), lambda x: F.length(F.regexp_replace(x, "[.,]", "")) > 1)))


def missing_numbers(found: Column, source_numbers: Column) -> Column:
    """Those of a body's numbers that its source hasn't, comma and dot alike."""
    dots = lambda a: F.transform(a, lambda y: F.replace(y, F.lit(","), F.lit(".")))
    return F.transform(F.array(dots(source_numbers)), lambda s: F.filter(found, lambda x: ~F.array_contains(s, F.replace(x, F.lit(","), F.lit(".")))))[0]


def est_tokens(c: Column) -> Column:
    return F.floor(F.length(c) / 4).cast("long")


def money(c: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(c, 2))


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(WORD), F.lit(0))


def caesar(c: Column, k: int) -> Column:
    """ASCII letters moved by k places, round the alphabet."""
    k %= 26
    to = LOWER[k:] + LOWER[:k]
    return F.translate(c, LOWER + LOWER.upper(), to + to.upper())


def share_of(found: Column, of: Column) -> Column:
    """size(found) / size(of), 0 for nothing."""
    return F.when(F.size(of) > 0, F.size(found) / F.size(of)).otherwise(F.lit(0.0))


def one_of(values: list[str]):
    return lambda w: w.isin(values)


def stop_ratio(lower_words: Column) -> Column:
    return share_of(F.filter(lower_words, one_of(STOP_WORDS)), lower_words)


def shifted_stops(k: int) -> list[str]:
    """The words that become frequent ones when their ASCII letters are moved by k places."""
    back = {c: chr((ord(c) - 97 - k) % 26 + 97) for c in LOWER}
    return ["".join(back.get(c, c) for c in w) for w in STOP_WORDS]


def garbled(text: Column) -> Column:
    """Whether a block of eight words or more is shifted or vowel-less text; citations and lists of years aren't.

    The words are taken once, and instead of the text the list of frequent words is shifted.
    """
    plain = ~text.rlike(CITATION) & (F.regexp_count(text, F.lit(YEAR)) < 2)

    def judged(w):
        shift = F.lit(False)
        for k in SHIFTS:
            shift = shift | (share_of(F.filter(w, one_of(shifted_stops(k))), w) >= SHIFT_SHARE)
        long = F.filter(w, lambda x: F.length(x) >= 4)
        mute = share_of(F.filter(long, lambda x: ~x.rlike(VOWELS)), long) >= MUTE_SHARE
        return F.when(F.size(w) < BLOCK_WORDS, F.lit(False)).when(stop_ratio(w) >= STOP_SHARE, F.lit(False)).otherwise(plain & (shift | mute))

    return F.transform(F.array(F.transform(words(text), lambda x: F.lower(x))), judged)[0]


def lost_symbols(text: Column) -> Column:
    """Whether an encoding lost signs before numbers; texts without a mark that could stand for one are passed over quickly."""
    may = F.contains(text, F.lit("$")) | F.contains(text, F.lit("#")) | text.rlike("(?<![0-9A-Za-z])[,.]")
    return may & text.rlike(SYMBOL_LOSS)


def unreliable(plain: Column, native: Column, blocks: Column) -> Column:
    """Why a page's own text can't be trusted: the first reason that applies, or an empty string. blocks: the blocks of its text."""
    return (
        F.when(F.regexp_count(plain, F.lit(BAD_CHARS)) >= BAD_COUNT, DAMAGED)
        .when(F.exists(blocks, garbled), DAMAGED)
        .when(lost_symbols(plain), SYMBOLS)
        .when(plain.rlike(LINE_CAPTION) | native.rlike(LINE_CAPTION), BOXED)
        .otherwise("")
    )


def clean_body(c: Column) -> Column:
    """Lone closing marks go: a first line of one, and lines of two or three."""
    c = F.regexp_replace(strip(c), r"^>[ \t]*\n", "")
    return strip(F.regexp_replace(c, r"(?md)^[ \t]*>{2,3}[ \t]*(?:\n|$)", ""))


def dehyphenate(c: Column) -> Column:
    return F.regexp_replace(c, r"-\n(?=\p{Ll})", "")


#: fixed values: the message of a text that is too long, what it is shown as, and where other errors have theirs
TOO_LONG = r"prompt is too long: (\d+) tokens > (\d+) maximum"
TOO_LONG_SHOWN = "el texto es demasiado largo para {model} ({tokens} tokens; máximo {most})"
MESSAGE = "message='([^']+)'"


def friendly_error(c: Column, model: str = "el modelo") -> Column:
    """A text that is too long is told with its numbers; of other errors the quoted message, or all, to 200 characters."""
    n = lambda k: F.format_number(F.nullif(F.regexp_extract(c, TOO_LONG, k), F.lit("")).cast("long"), 0)
    found = F.coalesce(F.nullif(F.regexp_extract(c, MESSAGE, 1), F.lit("")), c)
    return F.when(c.rlike(TOO_LONG), fill(TOO_LONG_SHOWN, {"model": F.lit(model), "tokens": n(1), "most": n(2)})).otherwise(F.substring(found, 1, 200))


def json_text(c: Column) -> Column:
    """A string as a JSON literal."""
    return F.regexp_replace(F.to_json(F.array(c)), r"(?s)^\[|\]$", "")


def json_object(c: Column) -> Column:
    """From the first brace to the last, whatever stands around (fences of code, remarks); null without one."""
    return F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit(""))


def year_of(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"\d{4}", 0), F.lit("")).cast("int")


def pdf_year(c: Column) -> Column:
    """The year of a date as PDF metadata have it; null without one."""
    return F.nullif(F.regexp_extract(c, r"^D:(\d{4})", 1), F.lit(""))


def fill(template: str, values: dict[str, Column]) -> Column:
    out = F.lit(template)
    for k, v in values.items():
        out = F.replace(out, F.lit("{" + k + "}"), v)
    return out


def heading(size: Column, body: Column, chars: Column, bold: Column, lines: Column) -> Column:
    return F.when((chars < 150) & (size >= 1.35 * body), "# ").when((chars < 150) & ((size >= 1.15 * body) | (bold & (lines == 1) & (chars < 90))), "## ").otherwise("")
