"""Text operators as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import bind, running_sum

#: Patterns of headings, boundaries and identifiers.
UPPER = "A-ZÁÉÍÓÚÂÊÔÃÕÀÇ"
IDENTIFIER = (
    r"^(?:\d{1,2}:\d{2}(?::\d{2})?\b|\d{3}\.\d{3}\.\d{3}-\d{2}\b|\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2}\b|\d{1,2}/\d{1,2}/\d{2,4}\b"
    r"|\d{7}-\d{2}\.\d{4}\.\d\.\d{2}\.\d{4}\b|[\d.\-/:]+\s*$)"
)
NUMBERED = r"^\d{1,3}(?:\.\d{1,3}){0,3}\s*[–—.:)-]\s*([^\W\d_].*)$"
ROMAN = r"^[IVXLCDM]{1,7}\s*[–—.:)-]\s*([^\W\d_].*)$"
ARTICLE = rf"^(?:DOS?|DAS?)\s+[{UPPER}].+$"
UPPERCASE = rf"^[{UPPER}][{UPPER}\s\d./()_–—:-]{{5,}}$"
LEGACY_UPPER = "A-ZÁÉÍÓÚÂÊÔÃÕÇ"
LEGACY_HEADING = (
    rf"^(?:[IVXLCDM]+\s*[–—.:-]\s*.+|\d+(?:\.\d+)*\s*[–—.:-]\s*.+|(?:DOS?|DAS?|DO|DA)\s+[{LEGACY_UPPER}].+|[{LEGACY_UPPER}][{LEGACY_UPPER}\s\d./()_–—:-]{{5,}})$"
)
HARD_BOUNDARY = r"^(?:PÁGINA DE SEPARAÇÃO|Evento\s+\d+|Tipo documento:|PROCESSO(?:\s|$)|DOCUMENTO(?:\s|$))"
PAGE_SEPARATOR = "PÁGINA DE SEPARAÇÃO"
LONGEST_HEADING, LEAST_LETTERS, LEAST_RATIO = 180, 4, 0.5
QUESTION_TAIL = (
    r"(?is)[\s.;:]*(?:Caso\s+(?:n[aã]o\s+)?(?:encontre|localize)[^.?!]*?responda[^.?!]*?[.?!]?"
    r"|N[aã]o\s+(?:adicione|acrescente|crie)\s+(?:nada|informa[cç][oõ]es)[^.?!]*?[.?!]?)\s*"
)
LEAST_QUESTION = 20

# Python's \s, \w and \d are Unicode, the JVM's only with (?U)
_U = "(?U)"


def strip(text: Column) -> Column:
    """White space off both ends."""
    return F.regexp_replace(text, _U + r"^\s+|\s+\z", "")


def word_count(text: Column) -> Column:
    """White-space separated words."""
    return F.size(F.filter(F.split(text, _U + r"\s+"), lambda w: w != ""))


def normalize_question(text: Column) -> Column:
    """White space collapsed, answer-protocol boilerplate off the end where enough is left."""
    flat = F.trim(F.regexp_replace(text, _U + r"\s+", " "))
    bare = F.btrim(F.regexp_replace(flat, "(?U)" + QUESTION_TAIL + r"\z", ""), F.lit(" \t.;:"))
    return F.when(F.length(bare) >= LEAST_QUESTION, bare).otherwise(flat)


def reads_like_prose(text: Column) -> Column:
    """Letters enough for a title, and one word among them."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    dense = F.length(F.regexp_replace(text, _U + r"\s", ""))
    return (letters >= LEAST_LETTERS) & (letters / dense >= LEAST_RATIO) & text.rlike(r"\p{L}{3}")


def is_heading(text: Column) -> Column:
    """Whether a line is a section heading and no data."""
    line = strip(text)
    rest = F.when(line.rlike(_U + NUMBERED), F.regexp_extract(line, _U + NUMBERED, 1)).when(line.rlike(_U + ROMAN), F.regexp_extract(line, _U + ROMAN, 1))
    titled = F.when(rest.isNotNull(), reads_like_prose(rest)).otherwise((line.rlike(_U + ARTICLE) | line.rlike(_U + UPPERCASE)) & reads_like_prose(line))
    return (line != "") & (F.length(line) <= LONGEST_HEADING) & ~line.rlike(_U + IDENTIFIER) & titled


def is_legacy_heading(text: Column) -> Column:
    return (F.length(text) <= LONGEST_HEADING) & strip(text).rlike(_U + LEGACY_HEADING)


def is_hard_boundary(line: Column) -> Column:
    return line.rlike("(?iu)" + HARD_BOUNDARY)


def is_page_separator(line: Column) -> Column:
    return F.startswith(F.upper(line), F.lit(PAGE_SEPARATOR))


def stable_id(prefix: str, *values: Column) -> Column:
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(F.concat_ws("\x1f", *values).cast("binary"), 256), 1, 20))


def text_value(column: Column) -> Column:
    """Null-safe text without surrounding white space."""
    return F.coalesce(strip(column.cast("string")), F.lit(""))


def query_id(document_id: Column, index: Column) -> Column:
    return F.concat(document_id, F.lit(":q"), index.cast("string"))


def chunk_id(document_id: Column, version: str, index: Column, start: Column, end: Column) -> Column:
    return F.format_string(f"%s:v{version}:%04d:%d-%d", document_id, index, start, end)


def token_overflow(tokens: Column, most: int) -> Column:
    """The token count where it is over the limit, else null; no limit if ``most`` is 0."""
    return F.when(F.lit(most > 0) & (tokens > most), tokens)


def lines(text: Column) -> Column:
    """Non-empty lines as array<struct<text, start, end, kind>>: stripped, offsets in code points."""

    def described(piece: Column, at: Column) -> Column:
        start = (at + F.length(piece) - F.length(F.regexp_replace(piece, _U + r"^\s+", ""))).cast("int")
        return bind(strip(piece), lambda bare: F.struct(
            bare.alias("text"), start.alias("start"), (start + F.length(bare)).alias("end"),
            F.when(bare.startswith("|"), "table").otherwise("prose").alias("kind"),
        ))

    def placed(pieces: Column) -> Column:
        ends = running_sum(F.transform(pieces, lambda x: F.length(x) + 1))
        return bind(ends, lambda e: F.transform(pieces, lambda x, k: described(x, F.when(k == 0, 0).otherwise(F.get(e, k - 1)))))

    return F.filter(bind(F.split(text, r"[\r\n]", -1), placed), lambda x: x["text"] != "")


def run_label(model_id: Column, run: Column) -> Column:
    """The model's name; with the run's where several runs share it. To be used with a window count, see :func:`operators.report.run_labels`."""
    return F.concat(model_id, F.lit(" ("), run, F.lit(")"))
