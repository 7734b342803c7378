"""Text expressions: column in, column out, all inside the JVM unless the name says otherwise."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: patterns, tables and word lists that results depend on ----
MOJIBAKE_FROM, MOJIBAKE_TO = "§£¡©³µ¢ ", "çãáéóõâ "
SOFT_HYPHEN = "­"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"(?:\+?\d{2}\s*)?(?:\(?\d{2}\)?\s*)?(?:\d{4,5}[-\s]?\d{4})"
PHONE_IN_QUESTION = r"\(?\d{2}\)?\s?\d{4,5}-\d{4}"
URL = r"https?://[^\s]+"
ACRONYM = r"\b[A-ZÀ-Ü]{2,6}(?:/[A-ZÀ-Ü]{2,6})*\b"
FOLDED_ACRONYM = r"\b[A-Z]{2,6}(?:/[A-Z]{2,6})*\b"
LETTERS = r"[A-Za-zÀ-ÖØ-öø-ÿ]+"
TERM = r"[A-Za-zÀ-ÖØ-öø-ÿ0-9]{3,}"
SENTENCE_END = r"(?<=[.!?;:])\s+|\n+"
NAME_SEQUENCE = r"[A-ZÁ-Ü][a-zá-ü]+(?:\s+[A-ZÁ-Ü][a-zá-ü]+){1,5}"
TITLE_PREFIX = r"(?i)^(prof(?:essor)?a?|prof\.?|profa\.?|profa|professora|dr\.?|dra\.?|doutor(?:a)?)\s+"
STOP_TERMS = (
    "que", "qual", "quais", "sobre", "para", "como", "onde", "quem", "contato", "email", "e-mail", "fone", "telefone", "ramal",
    "da", "de", "do", "um", "uma", "o", "a", "os", "as",
)
GREETINGS = ("oi", "ola", "olá", "hello", "hi", "teste", "ping", "bom dia", "boa tarde", "boa noite", "tudo bem", "como vai")
PHONE_WORDS = ("telefone", "tel", "ramal", "numero", "número", "celular", "whatsapp")
EMAIL_WORDS = ("email", "e-mail", "mail")
GENERIC_NAME_TOKENS = (
    "bacharelado", "departamento", "secretaria", "curso", "corpo", "docente", "telefones", "contato", "impressao", "reserva", "servico", "faculdade",
)
HINT_WORDS = {"computacao": ("computacao", "comp.", "bcc", "bsi", "dco"), "psicologia": ("psicologia", "dpsi"), "biologia": ("biologia", "dcb")}
ASK_QUESTION, ASK_DETAIL = "Não entendi. Pode escrever sua pergunta?", "Pode detalhar melhor a sua pergunta?"
ORDINAL_IN_WORD, ORDINAL_BEFORE_LOWER, ORDINAL_BEFORE_UPPER = r"(?U)(?<=\w)ª(?=\w)", r"(?<![0-9nN])º(?=[a-záéíóúãõêô])", r"(?<![0-9nN])º(?=[A-ZÁÉÍÓÚÃÕÊÔ])"
BROKEN_NAME, WHOLE_NAME = "Ant´nio", "Antônio"
# ---- end of fixed values ----


def _fold_table() -> tuple[str, str]:
    """Letters of Latin-1 and Latin Extended-A and their bases, from Unicode's decompositions."""
    pairs = [(c, unicodedata.normalize("NFD", c)[0]) for c in map(chr, range(0xC0, 0x180)) if len(unicodedata.normalize("NFD", c)) == 2]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


FOLD_FROM, FOLD_TO = _fold_table()


def strip_accents(c: Column) -> Column:
    return F.translate(c, FOLD_FROM, FOLD_TO)


def fold(c: Column) -> Column:
    """Lower case without accents."""
    return F.lower(strip_accents(c))


def fold_text(s: str | None) -> str:
    """:func:`fold` for a driver-side string."""
    return "".join(ch for ch in unicodedata.normalize("NFD", s or "") if not unicodedata.combining(ch)).lower()


def fold_ascii(c: Column) -> Column:
    """Lower case, ordinal signs as letters, what is left outside ASCII removed."""
    return F.lower(F.regexp_replace(F.translate(strip_accents(c), "ªº", "ao"), r"[^\x00-\x7F]", ""))


def squeeze(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    # a run of one space stays, so most texts have nothing to replace
    return F.trim(F.regexp_replace(c, r"[\t\n\x0B\f\r]\s*| \s+", " "))


def map_mojibake(c: Column) -> Column:
    """Single characters that an encoding round trip has left behind."""
    return F.translate(c, MOJIBAKE_FROM + SOFT_HYPHEN, MOJIBAKE_TO)


#: Windows-1252 characters of the bytes 0x80 to 0x9F, and the control characters that Latin-1 has there.
_C1 = [(ch, chr(b)) for b in range(0x80, 0xA0) if (ch := bytes([b]).decode("cp1252", "ignore"))]


def undo_latin1(c: Column) -> Column:
    """Lines whose UTF-8 bytes were once read as Latin-1 or Windows-1252 as they were meant; others unchanged."""

    def line(x: Column) -> Column:
        plain = F.translate(x, "".join(a for a, _ in _C1), "".join(b for _, b in _C1))
        raw = F.encode(F.when(plain.rlike("^[\\x{0}-\\x{ff}]*$"), plain), "ISO-8859-1").cast("string")
        return F.when(x.rlike("[\u00c2-\u00f4]") & F.is_valid_utf8(raw), raw).otherwise(x)

    return let(c, lambda x: F.when(x.rlike("[\u00c2-\u00f4]"), F.array_join(F.transform(F.split(x, "\n", -1), line), "\n")).otherwise(x))


def _compositions() -> list[tuple[str, str]]:
    """(base and mark, letter) for the letters of Latin-1 and Latin Extended-A, from Unicode's decompositions."""
    return [(d, c) for c in map(chr, range(0xC0, 0x180)) if len(d := unicodedata.normalize("NFD", c)) == 2]


def compose(c: Column) -> Column:
    """Latin letters followed by a combining mark as one character (NFC for those letters)."""
    pairs = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(x).alias("x")) for d, x in _compositions()])
    return let(c, lambda t: F.when(t.rlike("[\u0300-\u036f]"), F.aggregate(pairs, t, lambda text, p: F.replace(text, p["d"], p["x"]))).otherwise(t))


def repair(c: Column) -> Column:
    """Mojibake repair: encoding round trips undone, the character table, ordinal signs inside words, one name, composed
    letters."""
    c = map_mojibake(compose(undo_latin1(c)))
    c = F.regexp_replace(c, ORDINAL_IN_WORD, "ê")
    c = F.regexp_replace(c, ORDINAL_BEFORE_LOWER, "ú")
    c = F.regexp_replace(c, ORDINAL_BEFORE_UPPER, "Ú")
    return compose(F.replace(c, F.lit(BROKEN_NAME), F.lit(WHOLE_NAME)))


def cache_form(c: Column) -> Column:
    return F.lower(squeeze(repair(c)))


def letters(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(LETTERS), 0)


#: The characters of LETTERS that fold to another one, and that one.
_RAISED = [(c, fold_text(c)) for c in map(chr, [*range(0x41, 0x5B), *range(0xC0, 0xD7), *range(0xD8, 0xDF)])]
_LOWERED = [(c, unicodedata.normalize("NFD", c)[0]) for c in map(chr, range(0xDF, 0x100)) if len(unicodedata.normalize("NFD", c)) == 2]

#: Each character of LETTERS and what it folds to.
FOLDED_LETTERS = {c: c for c in map(chr, range(256)) if re.match(LETTERS, c)} | dict(_RAISED) | dict(_LOWERED)


def bm25_tokens(c: Column) -> Column:
    """Folded letter runs of two characters or more. Each letter folds to one letter, so the whole text is folded before
    it is cut, in one pass; characters outside the runs stay as they are and bound them as before."""
    folded = F.when(c.rlike(r"[^\x00-\x7F]"), F.translate(c, *["".join(x) for x in zip(*_RAISED, *_LOWERED, strict=True)])).otherwise(F.lower(c))
    return F.regexp_extract_all(folded, F.lit(f"{LETTERS[:-1]}{{2,}}"), 0)


def candidate_terms(c: Column) -> Column:
    """E-mails, then words of three characters or more, without stop terms, first spelling of each."""
    q = F.trim(c)
    found = F.concat(F.regexp_extract_all(q, F.lit(EMAIL), 0), F.regexp_extract_all(q, F.lit(TERM), 0))
    keep = F.filter(found, lambda x: ~fold(x).isin(*STOP_TERMS))
    return first_spellings(keep)


def let(value: Column, fn) -> Column:
    """``fn`` of a value that is worked out once: a lambda's variable isn't computed again for each element."""
    return F.get(F.transform(F.array(value), lambda x: fn(x)), F.lit(0))


def first_spellings(words: Column) -> Column:
    """Of words that fold alike, the first."""
    pick = lambda ws, fs: F.transform(F.array_distinct(fs), lambda f: F.element_at(ws, F.array_position(fs, f).cast("int")))
    return let(words, lambda ws: let(F.transform(ws, fold), lambda fs: pick(ws, fs)))


def question_tokens(c: Column) -> Column:
    words = F.filter(F.split(fold(c), r"\s+"), lambda x: x != "")
    return F.array_union(F.transform(candidate_terms(c), fold), words)


def emails(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(EMAIL), 0), F.lower)))


def normalize_phone(c: Column) -> Column:
    d = F.regexp_replace(c, r"\D", "")
    s = lambda a, n: F.substring(d, a, n)
    return (
        F.when(F.length(d) == 11, F.concat(F.lit("("), s(1, 2), F.lit(") "), s(3, 5), F.lit("-"), s(8, 4)))
        .when(F.length(d) == 10, F.concat(F.lit("("), s(1, 2), F.lit(") "), s(3, 4), F.lit("-"), s(7, 4)))
        .otherwise(F.trim(c))
    )


def phones(c: Column, pattern: str = PHONE) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(pattern), 0), normalize_phone)))


def urls(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(URL), 0)))


def acronyms(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(ACRONYM), 0)))


def acronyms_folded(c: Column) -> Column:
    plain = F.regexp_replace(strip_accents(c), "ß", "ss")
    return F.array_sort(F.array_distinct(F.regexp_extract_all(plain, F.lit(FOLDED_ACRONYM), 0)))


def protected(c: Column) -> Column:
    """Whether a span holds an e-mail, phone, URL or acronym, so it must not be cut."""
    return c.rlike(EMAIL) | c.rlike(PHONE) | c.rlike(URL) | c.rlike(ACRONYM)


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, SENTENCE_END), squeeze), lambda x: x != "")


def blocks(c: Column) -> Column:
    return F.filter(F.split(c, r"\n\s*\n+"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")) != "")


def paragraphs(c: Column) -> Column:
    """Paragraphs, the stripped lines of each joined by a space."""
    cut = F.split(F.regexp_replace(F.regexp_replace(c, "\r\n", "\n"), "\r", "\n"), r"\n{2,}")
    lines = lambda p: F.filter(F.transform(F.split(p, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.filter(F.transform(cut, lambda p: F.array_join(lines(p), " ")), lambda x: x != "")


def section_title(c: Column) -> Column:
    line = F.try_element_at(F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: x != ""), F.lit(1))
    return F.when(F.length(line) > 120, F.concat(F.rtrim(F.substring(line, 1, 117)), F.lit("..."))).otherwise(line)


def token_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"\s+"), lambda x: x != ""))


def leading_url(c: Column) -> Column:
    """The first line with text, if it begins with http:// or https://; else null."""
    first = F.trim(F.regexp_extract(c, r"^\s*([^\n]*)", 1))
    return F.when(first.rlike(r"(?i)^https?://"), first)


def preview(c: Column, size: int = 200, ellipsis: bool = True) -> Column:
    flat = F.trim(F.regexp_replace(c, "\n", " "))
    cut = F.rtrim(F.substring(flat, 1, size))
    return F.when(F.length(flat) > size, F.concat(cut, F.lit("...")) if ellipsis else cut).otherwise(flat)


def similarity(a: Column, b: Column) -> Column:
    """1 - Levenshtein distance / longer length; 1 for two empty strings."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longer)


def name_like(c: Column) -> Column:
    return c.rlike(r"^\p{L}{5,}$")


def clean_name(c: Column) -> Column:
    plain = F.btrim(c, F.lit(":- –—"))
    return F.trim(F.regexp_replace(F.regexp_replace(plain, TITLE_PREFIX, ""), r"\s{2,}", " "))


def generic_name(c: Column) -> Column:
    """Whether a name has fewer than two words or a word that no person bears."""
    tokens = F.transform(letters(c), fold)
    return (F.size(F.filter(F.split(c, r"\s+"), lambda x: x != "")) < 2) | F.arrays_overlap(tokens, F.array(*map(F.lit, GENERIC_NAME_TOKENS)))


def contains_any(c: Column, words: tuple[str, ...]) -> Column:
    """Whether the folded text holds one of the words (folded as well)."""
    out = F.lit(False)
    for w in dict.fromkeys(map(fold_text, words)):
        out = out | fold(c).contains(w)
    return out


def wants_email(c: Column) -> Column:
    return contains_any(c, EMAIL_WORDS)


def wants_phone(c: Column) -> Column:
    return contains_any(c, PHONE_WORDS)


def department_hint(c: Column) -> Column:
    """A department that the question names outright, else null."""
    out, q = None, fold(c)
    for slug, told in HINT_WORDS.items():
        hit = F.greatest(*[q.contains(w) for w in told])
        out = F.when(hit, slug) if out is None else out.when(hit, slug)
    return out


def triage(c: Column) -> Column:
    """struct<action, message>: whether a question can be answered at all."""
    q = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    ask = lambda m: F.struct(F.lit("ask_clarification").alias("action"), F.lit(m).alias("message"))
    answer = F.struct(F.lit("answer").alias("action"), F.lit(None).cast("string").alias("message"))
    return F.when(F.length(q) < 2, ask(ASK_QUESTION)).when(q.isin(*GREETINGS), ask(ASK_DETAIL)).otherwise(answer)


def local_variants(c: Column) -> Column:
    """The question, lower-cased, without question marks, and with two interrogatives spelt out."""
    q = F.trim(c)
    spelt = F.replace(F.replace(q, F.lit("quais"), F.lit("quais são")), F.lit("qual"), F.lit("qual é"))
    return F.array_distinct(F.array(q, F.lower(q), F.trim(F.replace(q, F.lit("?"), F.lit(""))), spelt))


def clean_variant(c: Column) -> Column:
    return squeeze(F.regexp_replace(F.trim(c), r"^[-*\d.)(]+\s*", ""))


def term_variants(term: Column, aliases: Column) -> Column:
    """Spellings of a folded term: itself, ``aliases`` (array) and the eia / ea endings."""
    t = fold(term)
    extra = F.array(
        F.when(t.endswith("eia"), F.concat(F.expr("''"), F.regexp_replace(t, "eia$", "ea"))),
        F.when(t.endswith("ea"), F.regexp_replace(t, "ea$", "eia")),
    )
    return F.array_compact(F.array_distinct(F.concat(F.array(t), F.coalesce(F.transform(aliases, fold), F.array().cast("array<string>")), extra)))


def context_window(text: Column, name: Column, before: int = 220, after: int = 300) -> Column:
    """Text around the first occurrence of ``name``, else null."""
    at = F.instr(text, name)
    start = F.greatest(F.lit(1), at - before)
    return F.when((at > 0) & (F.length(name) > 0), squeeze(F.substring(text, start, at - start + F.length(name) + after)))


def sigmoid_confidence(c: Column) -> Column:
    """A best score as a confidence: itself within 0 and 1, its logistic value outside, 0 for none."""
    return F.when(c.isNull(), F.lit(0.0)).when(c.between(0, 1), c).otherwise(1 / (1 + F.exp(-c)))


def diversity_weight(question: Column, lam: float, lam_short: float) -> Column:
    """The weight of relevance against diversity: the smaller one for questions of six words or fewer."""
    return F.when(F.size(letters(question)) <= 6, min(lam, lam_short)).otherwise(lam)


def safe_score(c: Column) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(float("-inf")))


def clean_score(c: Column) -> Column:
    return F.coalesce(F.nanvl(c.cast("double"), F.lit(0.0)), F.lit(0.0))


def label_of_file(c: Column) -> Column:
    return F.replace(F.regexp_replace(F.regexp_extract(c, r"([^/]*)$", 1), r"\.[^.]*$", ""), F.lit("_"), F.lit(" "))


def safe_label(c: Column) -> Column:
    return F.regexp_replace(c, r"[^a-zA-Z0-9_-]+", "-")


def short_hash(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 12)


def first_json(c: Column, schema: str) -> Column:
    """The whole text as JSON, else its widest {...} block, else null."""
    return F.coalesce(F.from_json(F.when(c.rlike(r"(?s)^\s*\{.*\}\s*$"), c), schema), F.from_json(F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit("")), schema))
