"""Quality rules, line first, with DataFrame functions only.

Each line is judged by itself: navigation, boilerplate, lines full of symbols, and short ones that end without
punctuation are removed. A document goes if it fails the two base rules (too few words, too much of it in repeated
three-word windows) or if more than half of its characters stood in removed lines. Everything is computed within the
row: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import WORD

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]+"
MIN_WORDS = 50
#: A document goes if it loses more than this share of the characters of its words.
MOST_LOST = 0.5
#: A line is boilerplate if its phrases make up this share of its characters; prose may mention one.
MOST_BOILERPLATE = 0.1
#: A line may consist of symbols up to this share.
MOST_SYMBOLS = 0.1
#: A line without closing punctuation must have as many words.
SHORT_LINE = 4
# Fixed phrases, as they stand on pages in English, German, French and Spanish.
PHRASES = (
    "all rights reserved", "cookie policy", "cookie settings", "we use cookies", "accept cookies", "accept all cookies", "privacy policy", "terms of use",
    "terms of service", "terms and conditions", "enable javascript", "javascript is disabled", "javascript is required", "click here", "read more", "sign in",
    "sign up", "log in", "subscribe now", "subscribe to our", "share this", "powered by", "skip to content", "skip to main content", "back to top",
    "add to cart", "contact us", "about us", "lorem ipsum",
    "alle rechte vorbehalten", "wir verwenden cookies", "cookies akzeptieren", "alle cookies akzeptieren", "cookie-einstellungen", "datenschutzerklärung",
    "nutzungsbedingungen", "impressum", "hier klicken", "weiterlesen", "mehr erfahren", "jetzt anmelden", "newsletter abonnieren", "zum inhalt springen",
    "nach oben", "in den warenkorb",
    "tous droits réservés", "nous utilisons des cookies", "accepter les cookies", "tout accepter", "politique de confidentialité", "mentions légales",
    "conditions d'utilisation", "conditions générales", "cliquez ici", "lire la suite", "en savoir plus", "se connecter", "s'inscrire", "aller au contenu",
    "retour en haut", "ajouter au panier",
    "todos los derechos reservados", "utilizamos cookies", "usamos cookies", "aceptar cookies", "aceptar todas las cookies", "política de privacidad",
    "política de cookies", "aviso legal", "términos de uso", "términos y condiciones", "haga clic", "haz clic", "leer más", "iniciar sesión",
    "regístrate", "ir al contenido", "volver arriba", "añadir al carrito",
)


def _one_of(phrases: tuple[str, ...]) -> str:
    """A pattern for any of the phrases, by common beginnings, so that most places are dismissed at their first letter."""
    heads: dict[str, list[str]] = {}
    for x in phrases:
        heads.setdefault(x[:1], []).append(x[1:])
    if len(heads) == 1 and "" in heads:
        return ""
    parts = []
    for c, rest in sorted(heads.items(), reverse=True):  # a longer phrase before one that begins it
        c = c if c.isascii() else f"[{c}{c.upper()}]"
        parts.append(c + _one_of(tuple(rest)) if c != "[]" and c else "")
    return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"


BOILERPLATE = rf"(?i)\b{_one_of(PHRASES)}\b"
#: A line is navigation if it has two separators or more, and every part ahead of one has from 1 to so many characters, the last one up to as many.
PART = 40
SEPARATOR = "[|»›•·>]"
CLOSED = r"[.!?:;,…\"'”’)\]。！？][\x20\x09-\x0D]*$"
#: A document of up to so many distinct repeated windows looks each of them up in turn; one of more sorts its windows.
FEW = 128


def navigation(line: Column) -> Column:
    """Short parts between separators. Plain patterns that repeat no group, so that no line is too long for the matcher."""
    two = line.rlike(f"{SEPARATOR}{SEPARATOR.replace('[', '[^')}*{SEPARATOR}")
    return two & ~line.rlike(f"^{SEPARATOR}|{SEPARATOR}{{2}}") & ~line.rlike(f"{SEPARATOR.replace('[', '[^')}{{{PART + 1}}}")


def boilerplate(line: Column) -> Column:
    """Phrases make up a share of the line, whatever its length."""
    return line.rlike(BOILERPLATE) & ((F.length(line) - F.length(F.regexp_replace(line, BOILERPLATE, ""))) >= MOST_BOILERPLATE * F.length(line))


def bad_line(line: Column) -> Column:
    """True for a line with words that fails a rule."""
    short = line.rlike(WORD) & ~line.rlike(rf"^[\x20\x09-\x0D]*(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]++){{{SHORT_LINE - 1}}}[^\x20\x09-\x0D]")
    symbols = line.rlike(SYMBOLS) & ((F.length(line) - F.length(F.regexp_replace(line, SYMBOLS, ""))) > MOST_SYMBOLS * F.length(line))
    return boilerplate(line) | navigation(line) | (short & ~line.rlike(CLOSED)) | symbols


def _repeat_words(grams: str, twice: str) -> Column:
    """Words in three-word windows that a text holds at least twice, from the windows' hashes and the repeated hashes."""
    few = f"array_remove(transform({grams}, (g, i) -> if(array_contains({twice}, g), i, -1)), -1)"
    many = (
        f"array_remove(array_sort(transform(sequence(0, size(sorted) - 1), i -> if("
        f"(i > 0 and get(sorted, i - 1).g = sorted[i].g) or (get(sorted, i + 1).g is not null and get(sorted, i + 1).g = sorted[i].g), sorted[i].i, -1))), -1)"
    )
    many = f"element_at(transform(array(sort_array(transform({grams}, (g, i) -> struct(g as g, i as i)))), sorted -> {many}), 1)"
    count = "aggregate(at, struct(0 as upto, 0L as n), (a, p) -> struct(p + 3 as upto, a.n + 3 - greatest(0, a.upto - p) as n), a -> a.n)"
    return F.expr(f"case when size({twice}) = 0 then 0L else element_at(transform(array(case when size({twice}) <= {FEW} then {few} else {many} end), at -> {count}), 1) end")


def _judged(docs: DataFrame, keep: list[Column]) -> DataFrame:
    """``keep`` and the counts and verdicts. Intermediate columns are each used more than once, so the planner keeps them apart."""
    t = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select(*keep, t.alias("t")).withColumn("w", F.array_remove(F.split("t", SPACES), ""))
    d = d.withColumn("n_words", F.size("w").cast("long"))
    d = d.withColumn("g", F.expr("case when size(w) < 3 then cast(array() as array<bigint>) else transform(sequence(0, size(w) - 3), i -> xxhash64(get(w, i), get(w, i + 1), get(w, i + 2))) end"))
    d = d.withColumn("s", F.expr("case when size(array_distinct(g)) = size(g) then cast(array() as array<bigint>) else sort_array(g) end"))
    d = d.withColumn("dup", F.expr("case when size(s) = 0 then s else array_distinct(filter(s, (x, i) -> i > 0 and x = get(s, i - 1))) end"))
    d = d.withColumn("n_repeat_words", _repeat_words("g", "dup"))
    d = d.withColumn("lines", F.split("t", "\n"))
    d = d.withColumn("inked", F.filter("lines", lambda x: x.rlike(WORD)))
    d = d.withColumn("word_chars", F.length(F.array_join("w", "")).cast("long"))
    d = d.withColumn("n_symbols", (F.length("t") - F.length(F.regexp_replace("t", SYMBOLS, ""))).cast("long"))
    d = d.withColumn("n_dup_lines", (F.size("inked") - F.size(F.array_distinct("inked"))).cast("long"))
    d = d.withColumn("good", F.filter("lines", lambda x: ~bad_line(x)))
    d = d.withColumn("clean", F.array_join("good", "\n"))
    d = d.withColumn("left", F.when(F.size("good") == F.size("lines"), F.col("word_chars")).otherwise(F.length(F.regexp_replace("clean", SPACES, ""))))
    d = d.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return d.withColumn("kept", ~F.col("base_failed") & (F.col("left") >= (1 - MOST_LOST) * F.col("word_chars")))


def _barrier(d: DataFrame, rows: Column) -> DataFrame:
    """Rows of an array of structs. A filter above is not pushed below this, where it would repeat all that it needs."""
    return d.select(F.inline(rows))


def judge(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines_removed.

    A null or empty text has no words and fails the base; a null id stays null; repeated rows are judged alike, each by
    itself; texts of any length are judged whole. Other columns are not read; an empty table gives no rows.
    """
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    removed = (F.size("lines") - F.size("good")).cast("long").alias("n_lines_removed")
    return _barrier(_judged(docs, [F.col("doc_id")]), F.array(F.struct(*names, removed)))


def clean_documents(docs: DataFrame) -> DataFrame:
    """The documents kept, with the columns of ``docs``; text is without the removed lines, and n_chars follows it."""
    d = _judged(docs, [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r")])
    row = F.struct("r", "clean")
    d = _barrier(d, F.filter(F.array(F.when(F.col("kept"), row)), lambda x: x.isNotNull()))
    out = {c: F.col("r").getField(c) for c in docs.columns}
    out["text"] = F.col("clean")
    if "n_chars" in docs.columns:
        out["n_chars"] = F.length("clean").cast(docs.schema["n_chars"].dataType)
    return d.select(*[out[c].alias(c) for c in docs.columns])
