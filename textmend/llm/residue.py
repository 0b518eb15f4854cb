"""Problem 3: template residue, filler, error pages and script notices.

Each placeholder delimiter has a grammar of its own (what may stand between the signs). A hit counts
only if its surroundings don't speak of it: a hit quoted or set in backticks, one inside a line of
program text, and one that its sentence speaks of is discounted, and so are all hits of a tutorial (three
or more, of which half are discounted). Filler, error messages and notices are judged by density at any
length: the message has to be the text, not a mention in it.

Null, blank and asterisks-only texts are never residue. Every row is judged by its whole text.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmend.plans.arrow import map_batches
from textmend.plans.runtime import table

_NAME = r"[A-Za-z][\w]*"
#: One grammar per delimiter: double braces, block tags, print tags, guillemets, double brackets, dollar braces,
#: double underscores, per cent signs, bracketed instructions.
GRAMMARS = {
    "braces": rf"\{{\{{\s*{_NAME}(?:\.{_NAME}|\[\w+\])*(?:\s*\|\s*{_NAME}(?::[^{{}}]*)?)*\s*\}}\}}",
    "block_tag": r"\{%-?\s*(?:block|endblock|if|elif|else|endif|for|endfor|include|extends|set|with|endwith|load|trans|csrf_token)\b[^{}%]*-?%\}",
    "print_tag": rf"<%[=-]?\s*{_NAME}(?:[.\w()]*)\s*-?%>",
    "angles": rf"<<\s*{_NAME}(?:[ .]{_NAME})*\s*>>",
    "brackets": rf"\[\[\s*{_NAME}(?:[ .]{_NAME})*\s*\]\]",
    "dollar": rf"\$\{{\s*{_NAME}(?:\.{_NAME})*(?::-[^{{}}]*)?\s*\}}",
    "underscores": r"(?<![\w])__[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*__(?![\w])",
    "percents": r"(?<![\w%])%[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*%(?![\w%])",
    "instruction": r"\[(?:(?:INSERT|ENTER|ADD|PUT|TYPE)\b[^\[\]\n]{0,60}|(?:Your|Insert|Enter|Add|Type)\b[^\[\]\n]{0,60}\b(?:here|goes here)|[A-Z][A-Z ]{0,30}\b(?:TBD|TBA|TO COME|GOES HERE|HERE)|TBD|TBA|TODO(?::[^\[\]\n]*)?)\s*\]",
}
PLACEHOLDER = re.compile("|".join(f"(?P<{k}>{v})" for k, v in GRAMMARS.items()))
_TRIGGER = re.compile(r"\{\{|\{%|<%|<<|\[\[|\$\{|__[A-Z]|%[A-Z]|\[[A-Z]")
_QUOTES = "\"'`“”‘’«»„‚‹›"
_CODE_LINE = re.compile(r"^\s*(?:[$] |>>> |//|\w+\s*\(|(?:def|class|import|from|return|let|const|var|function|if|for)\b.*[:;({=])|[;{}]\s*$|`")
#: A sentence that speaks of placeholders, and words right before or after one that speak of it.
_SPEAKS = re.compile(r"(?i)\b(?:placeholders?|templates?|syntax|variables?|macros?|between (?:braces|brackets))\b")
_BEFORE = re.compile(r"(?i)\b(?:tags?|written|writes?|such as|for example|e\.g\.|means|called|named|spelt|signs?)[\s:,]+(?:(?:as|like|the|an?)\s+)?$")
_AFTER = re.compile(r"(?i)^\s*(?:\w+\s+)?(?:means|stands? for|tags?|is written|was written|signs?)\b")
_SENTENCE_EDGE = re.compile(r"[.!?…]\s")

# --- fixed values: the words of the usual Latin filler ------------------------------------------------------
LOREM = frozenset(
    "lorem ipsum dolor sit amet consectetur consectetuer adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et "
    "dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis "
    "aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non "
    "proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
)
#: Of those the ones that don't also occur as common words of the languages of the corpus.
LOREM_STRONG = LOREM - set("sit sed do et ut ad ex ea in non id est qui sunt esse minim dolor eu".split())
# --- fixed values: sentences used to fill a page -------------------------------------------------------------
FILLER = re.compile(
    r"(?i)^(?:(?:your |some |sample |dummy |filler |placeholder |example |body |default )*(?:text|content|paragraph|copy)(?: goes| comes| will (?:go|be|come))? ?(?:here|later)?"
    r"|text goes here|this is (?:a|an|some) (?:dummy|sample|placeholder|filler|example|test) (?:paragraph|text|sentence|page|chapter)"
    r"|(?:type|write|enter|insert|put|add|paste) your \w+(?: \w+)? here|sample text|dummy text|filler text|placeholder(?: text)?|blindtext|fülltext|platzhalter(?:text)?|beispieltext"
    r"|hier (?:steht|kommt|folgt)(?: später| bald)? (?:der|ihr|dein) text(?: hin)?|texte? d.exemple(?: ici)?|texte ici|(?:saisissez|écrivez|insérez|entrez|tapez) votre texte ici|votre texte ici"
    r"|(?:escriba|inserte|escribe|introduzca) (?:aquí )?su texto(?: aquí)?|texto de (?:ejemplo|relleno|muestra)(?: aquí)?|su texto aquí|lorem ipsum"
    r"|to ?do:? .*|tbd|tba|to be (?:done|written|added|announced|determined)|(?:content|text|chapter|page)(?: text)? (?:missing|to come|coming soon|pending)|coming soon)$"
)
# --- fixed values: what error pages and notices say ----------------------------------------------------------
_ERROR = (
    r"^error \d{3}\b|^\d{3} [a-z][a-z -]{2,40}$|http (?:status|error)(?: code)?:? ?\d{3}|request id:|^(?:internal server error|bad gateway|not found|forbidden|gone|service unavailable|gateway time-?out|unauthorized|bad request)$"
    r"|access (?:is |was )?denied|do not have permission to|traceback \(most recent call last\)|^fatal error\b|uncaught (?:exception|error)|stack trace|keyerror|nullpointerexception|segmentation fault"
    r"|something went wrong|(?:page|document|file|resource|url) (?:you are|you’re|you're) looking for|page (?:was |could )?not (?:be )?found|session has (?:expired|timed out)|please (?:sign|log) in again"
    r"|seite (?:wurde )?nicht gefunden|fehler \d{3}|page introuvable|n.existe pas|página no encontrada|no se encuentra la página|error al cargar|erreur \d{3}"
    r"|error establishing a (?:database )?connection|error establishing a database|server is (?:busy|down|overloaded|temporarily)|(?:temporarily|currently) unavailable|try again (?:later|in a few)|retry later"
    r"|no longer available|checking your browser|are you a (?:human|robot)|verify (?:that )?you are|complete the (?:check|captcha)|too many requests|rate limit|\[object object\]|nan of undefined|^undefined$|requested page could not|connection (?:timed out|refused|reset)|maintenance mode|under maintenance|under construction"
    r"|(?:cookies?|consent) (?:are|is|must be) (?:required|disabled|enabled)"
)
_SCRIPTS = (
    r"(?:enable|activate|turn on|switch on|allow|requires?|needs?|without|support|activer|activez|aktivieren|activar|active|activa|habilit\w+|einschalten) (?:\w+ ){0,3}(?:java ?scripts?|scripts)\b"
    r"|(?:java ?scripts?|scripts) (?:\w+ ){0,4}(?:disabled|required|switched off|turned off|blocked|désactivé|deaktiviert|desactivado|needed|enabled|erforderlich|nécessaire|necesario)|does not support scripts"
)
MESSAGE = re.compile(f"(?im)(?P<error>{_ERROR})|(?P<scripts>{_SCRIPTS})")
#: What else such pages say: sentences that count as the message's if there is one.
_AROUND = re.compile(r"(?i)\b(?:browser|server|url|web ?site|web ?page|home ?page|webmaster|administrator|support team|help ?desk|reload|refresh|bookmark|cookies?|log ?in|sign in|click|typed|inconvenience|navigateur|serveur|seite|página web|java ?script)\b")
#: Every match of the messages holds one of these or begins a line with three digits.
_MESSAGE_SIGNS = (
    "error", "http", "request id", "gateway", "not found", "forbidden", "gone", "unavailable", "time", "unauthorized", "bad request", "denied", "permission", "traceback", "exception", "stack trace", "segmentation",
    "wrong", "looking for", "session", "in again", "gefunden", "fehler", "introuvable", "existe pas", "encontrad", "encuentra", "cargar", "erreur", "server is", "try again", "retry", "no longer", "your browser",
    "human", "robot", "verify", "complete the", "too many", "rate limit", "[object", "undefined", "requested page", "connection", "maintenance", "construction", "cookie", "consent", "script",
)
_STATUS_LINE = re.compile(r"(?m)^\d{3} ")
#: A sentence of its own has so many words; those outside the message may have a third of its words.
SENTENCE_WORDS = 12
OUTSIDE = 1 / 3
#: A message has a sign in so many characters at least, so that longer texts with fewer need no closer look.
CHARS_A_SIGN = 400
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")


#: Every match of the filler rules holds one of these, so that other texts need no closer look.
_LATIN_SIGNS = ("ipsum", "dolor", "amet", "consect", "adipisc", "eiusmod", "incididunt", "labor", "aliqu", "nostrud", "ullamco", "veniam", "tempor", "magna", "commodo")
_FILLER_SIGNS = ("text", "content", "paragraph", "copy", " here", "dummy", "sample", "placeholder", "filler", "platzhalter", "todo", "to do", "tbd", "tba", "to be ", "missing", "coming soon", "lorem", " ici", "pending")


def _parts(text: str) -> list[str]:
    parts = (p.strip(" .!?…:\t\"“”«»") for p in re.split(r"(?<=[.!?…])\s+|\n+", text))
    return [p for p in parts if p]


def placeholders(text: str) -> list[tuple[str, str]]:
    """(grammar, placeholder) of each one left unfilled; those that the text speaks of don't count."""
    if not _TRIGGER.search(text):
        return []
    hits = list(PLACEHOLDER.finditer(text))
    if not hits:
        return []
    covered = sum(len(m.group()) for m in hits)
    dense = covered > 0.25 * len(text)
    left, told = [], 0
    for m in hits:
        before, after = text[: m.start()].rstrip(" "), text[m.end() :].lstrip(" ")
        quoted = bool(before) and bool(after) and before[-1] in _QUOTES and after[0] in _QUOTES and before == text[: m.start()]
        start, end = text.rfind("\n", 0, m.start()) + 1, text.find("\n", m.end())
        end = end if end >= 0 else len(text)
        rest = PLACEHOLDER.sub("", text[start:end])
        # signs of rights aren't program text, whatever ends their line
        code = bool(_CODE_LINE.search(rest)) and len(_WORD.findall(rest)) > 0 and "©" not in rest and not dense
        left_side, right_side = _SENTENCE_EDGE.split(text[start : m.start()])[-1], _SENTENCE_EDGE.split(text[m.end() : end])[0]
        sentence = PLACEHOLDER.sub(" ", f"{left_side} {right_side}")
        spoken = len(_WORD.findall(sentence)) >= 4 and bool(_SPEAKS.search(sentence) or _BEFORE.search(left_side) or _AFTER.search(right_side))
        if quoted or code or spoken:
            told += 1
        else:
            left.append((m.lastgroup or "", m.group()))
    return [] if len(hits) >= 3 and 2 * told >= len(hits) else left


def message(text: str, low: str) -> str | None:
    """'error' or 'scripts' if the text is such a message: its sentences are the message's, and little stands outside."""
    signs = sum(low.count(s) for s in _MESSAGE_SIGNS if s in low) + (len(_STATUS_LINE.findall(text)) if text[:1].isdigit() or "\n" in text else 0)
    if signs * CHARS_A_SIGN < len(text):
        return None
    own = outside = 0
    found = []
    for p in _parts(text):
        n = len(_WORD.findall(p))
        m = MESSAGE.search(p)
        if m:
            found.append(m)
        if m or _AROUND.search(p):
            own += n
        elif n >= SENTENCE_WORDS:
            outside += n
    if not found or outside > OUTSIDE * own:
        return None
    return "scripts" if any(m["scripts"] for m in found) else "error"


def classify(text: str | None) -> str | None:
    """'placeholder', 'filler', 'error', 'scripts' or None."""
    if text is None or not text.strip(" \t\r\n\f*﻿​"):
        return None
    if placeholders(text):
        return "placeholder"
    low = text.lower()
    if sum(w in low for w in _LATIN_SIGNS) >= 2:
        words = _WORD.findall(low)
        latin = sum(w in LOREM for w in words)
        if len(words) >= 4 and latin >= 0.7 * len(words) and sum(w in LOREM_STRONG for w in words) >= 0.3 * len(words):
            return "filler"
    # at least half of the sentences would have to hold a sign
    if 2 * sum(low.count(w) for w in _FILLER_SIGNS) > low.count(". "):
        parts = _parts(text)
        if sum(bool(FILLER.match(p)) for p in parts) >= 0.5 * len(parts):
            return "filler"
    return message(text, low)


def residue(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind) of the rows that are residue."""

    def run(cols: dict[str, list]) -> dict[str, list]:
        pairs = [(k, classify(s)) for k, s in zip(cols[key], cols[text], strict=True)]
        return {"record_id": [k for k, c in pairs if c], "kind": [c for _, c in pairs if c]}

    return map_batches(df.select(key, text), "record_id long, kind string", run)


def _both(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = residue(table(spark, sf_dir, "chapters"), "chapter_id", "document")
    marks = residue(table(spark, sf_dir, "gutenberg_markers"), "marker_id", "marker_text")
    return pages.withColumn("table_name", F.lit("chapters")).unionByName(marks.withColumn("table_name", F.lit("gutenberg_markers")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records to exclude, each once however often its row is repeated."""
    return _both(spark, sf_dir).select("table_name", "record_id").distinct()


def p3_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records to exclude, by table and kind of residue."""
    return _both(spark, sf_dir).distinct().groupBy("table_name", "kind").agg(F.count("*").alias("records"))


def p3_clean_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean rest of the pages; null and blank documents are kept, they are no residue."""
    pages = table(spark, sf_dir, "chapters")
    bad = residue(pages, "chapter_id", "document").select(F.col("record_id").alias("chapter_id")).distinct()
    return pages.select("chapter_id", "book_id", "page_no", "document").join(bad, "chapter_id", "left_anti")


QUERIES = {"p3_found": p3_found, "p3_kinds": p3_kinds, "p3_clean_pages": p3_clean_pages}
