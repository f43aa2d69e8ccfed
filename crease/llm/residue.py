"""Documents that are template residue, filler, an error page or a notice that scripts are needed.

Unfilled slots are found by one grammar for each kind of delimiter. Context discounts them: code blocks, a notation
that its sentence introduces as the subject ("written as {{name}}"), and texts that mostly quote notations (density).
For the rest, the share of a text that consists of residue decides: each sentence is read as filler, as part of an
error or notice page, as page furniture or as content, and a text is residue when at most a small share of it is
content, or when filler is a large one. Filler is measured, not listed: running text has function words, and keyboard
mash, random letters and pseudo-Latin have none; repeated words carry no content.

Every text is read whole and once, in one Arrow batch function. The literals that a match of each rule must contain
are derived from the rules themselves and searched by one automaton; a rule's regular expression runs on the sentences
that hold one of its literals. The one rule without a literal, a bare number, runs on sentences of one or two words.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crease.sources.tables import table

# A slot left unfilled, by delimiter.
SLOTS = (
    r"\{\{\{?\s*[\w.][\w. ]{0,40}\}?\}\}", r"\$\{\s*[\w.][\w. ]{0,40}\}", r"\{%\s*[\w.][^%{}\n]{0,40}%\}",
    r"<%=?\s*[\w.][^%<>\n]{0,40}%>", r"\[\[\s*[\w.][\w. ]{0,40}\]\]", r"%\([\w. ]{1,40}\)[sdif]",
    r"(?<!\w)%[A-Z][A-Z_]{1,40}%", r"__[A-Z][A-Z_]{0,40}__", r"@@[\w. ]{1,40}@@", r"#[A-Z][A-Z_]{1,40}#",
    r"\$[A-Z][A-Z_]{1,40}\$", r"<<\s*\w[\w. ]{0,40}>>", r"<[A-Z][A-Z_]{1,40}>", r"&lt;\s*\w[\w. ]{0,40}&gt;",
    r"«\s*[a-zA-Z][a-zA-Z0-9_. ]{0,40}»", r"\bXX-[A-Z_]{1,40}-XX\b", r"\[[A-Z][A-Z_ ]{1,40}\]",
    r"\[(?:[Ii]nsert|[Ee]nter|[Aa]dd|[Yy]our|[Ff]ill in|INSERT|ENTER|ADD|YOUR|FILL IN) [^\[\]\n]{1,40}\]",
    r"\[[a-z][\w ]{0,40} here\]", r"\([a-z][\w ]{0,40} to be (?:filled in|added|confirmed|announced|inserted)\)",
    r"(?<![\w{$%\"])\{[A-Za-z_][\w.]{0,40}\}(?!\})", r"(?<![\w{$%\"])\{\d{1,2}\}(?!\})",
)
# A machine's empty value in place of a word or figure.
EMPTY_VALUES = (
    r"\bNaN\b", r"\bundefined\b", r"\[object Object\]", r"\bnull\b", r"\bInvalid Date\b", r"\bNoneType\b",
    r"#(?:REF|VALUE|DIV/0|NAME)[!?]",
)
# The text speaks of such values or notations as its subject.
CODE = re.compile(r"```.*?```|`[^`\n]{1,200}`", re.S)
QUOTED_NOTATION = re.compile(
    r"(?:\bpattern|\bwritten as|\bspelled|\bsyntax|\bnotation|\b(?:placeholder|marker|tag)s? (?:like|such as))"
    r"\s+[\"'“‘]?(?:\S*[\[\]{}<>%@#$«»_]\S*)(?:\s*[\]})>%@#$»_]+)*",
    re.I,
)
SUBJECT_VALUES = re.compile(
    r"\bundefined (?:results?|values?|behaviou?rs?|terms?|outcomes?|innings)\b"
    r"|\bnan (?:averages?|values?|rows?|cells?|results?|entries)\b"
    r"|\b(?:become|becomes|became|is|are|as|to|or|and|not|with) null\b"
    r"|\bnull (?:values?|hypothesis|rows?|cells?|result|averages?)\b|\bdeclared null\b",
    re.I,
)
#: A text with so many notations in code or quotes for each bare one is about them, if it has at least so many.
TUTORIAL_RATIO, TUTORIAL_LEAST = 2, 4

# Template instructions and labels (in lower case), and rows of the keyboard.
FILLER_RULES = (
    r"\b(?:body|sample|dummy|filler|placeholder|your|demo) (?:text|copy|content)\b.{0,40}\b(?:goes here|here|before publishing|later)\b",
    r"\bthis is (?:dummy|sample|placeholder|filler) (?:copy|text|content)\b",
    r"^(?:\W*(?:text|title|headline|caption) goes here\W*)+$", r"^\W*(?:blah\W+){2,}(?:blah)?\W*$",
    r"^\W*(?:(?:asdf|qwer|qwerty|zxcv|hjkl|jkl|ty|test|123|aaa|bbb|ccc|ddd|eee|foo|bar|baz|x{2,})\b\W*){2,}$",
    r"^sample paragraph for\b", r"^write the \w+ paragraph of\b", r"^your (?:headline|title|story),? ",
    r"^(?:\W*(?:(?:sub)?heading|headline|byline|caption of photo|(?:first|second|third|last) point|(?:short )?summary|pull quote|lead sentence of about \w+ words)\b\W*)+$",
    r"नमूना पाठ", r"शीर्षक बाद में", r"यहाँ .{0,20}लिखें", r"\bclick (?:here )?to (?:edit|add)\b",
)
# Lines of an error page or of a notice that scripts or cookies are needed (in lower case).
SCRIPT = r"(?:java ?scripts?|js|scripts?|scripting|cookies)(?: and cookies)?"
PAGE_RULES = (
    rf"(?:^\W*|please )(?:enable|activate|turn on|switch on|allow) {SCRIPT}\b", rf"you need to (?:turn on|enable) {SCRIPT}",
    rf"does not work without {SCRIPT}", rf"(?:looks like|seems) {SCRIPT} (?:is|are) (?:switched|turned) off",
    rf"browser has (?:blocked|disabled) {SCRIPT}", rf"\b{SCRIPT} must be (?:allowed|enabled)", rf"may not run {SCRIPT}",
    rf"\b{SCRIPT} (?:is|are) (?:disabled|required to (?:view|run|use|load)|not (?:enabled|supported))", rf"{SCRIPT} chalu kar",
    r"जावास्क्रिप्ट", r"\bcookies are also required", r"\bolder browsers are not supported", r"\bthen reload the page\b",
    r"open settings, then site permissions", r"how to switch it on", r"checking your browser before", r"^loading…",
    r"^\**\s*please enable", r"^this (?:site|page|app) (?:needs|requires) ",
    r"^\W*(?:http )?error:? \d{3}\b",
    r"^\W*\d{3} (?:error|not found|forbidden|bad gateway|service unavailable|internal server error|unauthorized|gateway time-?out|too many requests|gone|conflict)",
    r"^\W*(?:not found|access denied|forbidden|page not found|service unavailable|bad gateway|internal server error|gateway time-?out|something went wrong|too many requests|unauthorized|session expired|maintenance)\W*$",
    r"your session has (?:ended|expired)", r"connection was refused", r"try again (?:in a few minutes|later)\W*$",
    r"has been told about the fault", r"^(?:request-id|request id|incident|ray|reference|trace|ref)\b[ :#]*[0-9a-f-]{3,}\W*$",
    r"do not have permission", r"too many attempts from", r"is not on this server", r"could not be found",
    r"took too long to answer", r"पृष्ठ नहीं मिला", r"उपलब्ध नहीं है", r"कुछ देर बाद फिर कोशिश", r"\{\"error\"",
    r"^traceback \(most recent", r"^\s*file \"[^\"]+\", line \d+", r"^\w*(?:error|exception): ", r"^\(?\d{3}\)?$",
    r"\bsign in again to carry on", r"\bcheck the address, or go back\b", r"\bmaintenance is under way\b",
    r"has moved or no longer exists", r"^\W*(?:oops|sorry)\W+we can.?t show this", r"something went wrong\W*$", r"^\W*gone\W*$",
    r"^\W*http \d{3}\b", r"^(?:warning|fatal error|notice|parse error): ", r"\bon line \d+$",
    r"temporarily (?:unavailable|down)", r"unexpected (?:error|condition)", r"went wrong on our side",
)
# Page furniture, which counts neither way.
FURNITURE = re.compile(
    r"^\W*(?:(?:home|menu|scores?|auction|squads?|login|log in|sign in|matches|players|skip to content|contact|about"
    r"|search|news|back to top|next|previous|privacy|terms)\b\W*)+$|^[^\w]*$"
)
# Words that running text of English, or of Hindi in Latin letters, cannot do without.
FUNCTION_WORDS = (
    "the of a an to in and for at on is was were with by that it as be from or not but this which who had has have his her their our we he she they "
    "i you after before when no its all are been will than then out into over under so if only my up between until each any there because both about "
    "while one two do does did can may must how what ke ki ka ko hai hain ne se par mein liye aur"
).split()

#: A text is residue when content makes up at most this share of it, or filler at least that.
CONTENT_SHARE, FILLER_SHARE = 0.25, 0.3
#: A paragraph of so many words at least is filler when function words are at most this share of it.
LEAST_WORDS, FUNCTION_SHARE = 8, 0.05
#: A sentence of four words or more whose distinct words are at most this share of it is filler.
DISTINCT_SHARE = 0.25


def needed_literals(pattern: str) -> set[str] | None:
    """Lower-case literals of which every match of ``pattern`` contains one; None if the pattern needs none."""
    from re import _constants as op
    from re import _parser as parser

    def of(sequence) -> set[str] | None:
        found, run = [], ""
        for kind, value in sequence:
            if kind is op.LITERAL:
                run += chr(value).lower()
                continue
            found, run = found + [{run}] if run else found, ""
            inner = None
            if kind is op.SUBPATTERN:
                inner = of(value[3])
            elif kind is op.BRANCH:
                parts = [of(x) for x in value[1]]
                inner = set().union(*parts) if all(parts) else None
            elif kind is op.MAX_REPEAT and value[0] >= 1:
                inner = of(value[2])
                if inner and len(value[2]) == 1 and value[2][0][0] is op.LITERAL:
                    inner = {x * value[0] for x in inner}
            elif kind is op.IN and all(k is op.LITERAL for k, _ in value):
                inner = {chr(v).lower() for _, v in value}
            if inner:
                found.append(inner)
        found = found + [{run}] if run else found
        # Long literals are rare, and marks are rarer than letters.
        rarity = lambda x: min(sum(1 if c.isalnum() or c == " " else 3 for c in y) for y in x)
        return max(found, key=lambda x: (rarity(x), -len(x)), default=None)

    return of(parser.parse(pattern))


class Rules:
    """The compiled rules and the automaton over their literals; built once for each task."""

    def __init__(self):
        import ahocorasick

        kinds = [("slot", p) for p in (*SLOTS, *EMPTY_VALUES)] + [("filler", p) for p in FILLER_RULES] + [("page", p) for p in PAGE_RULES]
        self.rules = [(kind, re.compile(p)) for kind, p in kinds]
        self.slot = re.compile("|".join(f"(?:{p})" for p in (*SLOTS, *EMPTY_VALUES)))
        by_literal: dict[str, list[int]] = {}
        self.always = []
        for i, (_, p) in enumerate(kinds):
            literals = needed_literals(p)
            for x in literals or ():
                by_literal.setdefault(x, []).append(i)
            if literals is None:
                self.always.append(i)
        self.machine = ahocorasick.Automaton()
        for x, ids in by_literal.items():
            self.machine.add_word(x, ids)
        self.machine.make_automaton()
        self.function_words = frozenset(FUNCTION_WORDS)
        self.function = re.compile(r"\b(?:" + "|".join(FUNCTION_WORDS) + r")\b")
        self.running = re.compile(r"(?:(?<=[\s(\[“\"‘'])|^)[a-z]{2,}|(?:(?<=[.!?:]\s)|^)[A-Z][a-z]+")
        self.pieces = re.compile(r"\n+|(?<=[.!?।…])\s+(?=\S)")
        self.gaps = re.compile(r"\n\s*\n")
        self.stamp = re.compile(r"^\s*\d+\.\d+\s+")

    def slots(self, text: str) -> int:
        """Unfilled slots and empty values outside code and quoted notations; 0 in a text that is about them."""
        plain = CODE.sub(" ", text) if "`" in text else text
        bare = SUBJECT_VALUES.sub(" ", QUOTED_NOTATION.sub(" ", plain))
        n = sum(1 for _ in self.slot.finditer(bare))
        if n:
            quoted = sum(1 for _ in self.slot.finditer(text)) - n
            if quoted >= TUTORIAL_LEAST and quoted >= TUTORIAL_RATIO * n:
                return 0
        return n

    def meaningless(self, paragraph: str, low: str) -> bool:
        """No running text: almost no function words among many words, or few words over and over without any."""
        words = low.split()
        most = FUNCTION_SHARE * len(words)  # running words are at most as many
        k = 0
        for w in words:
            if w in self.function_words:
                k += 1
                if k > most:
                    return False
        k = len(self.function.findall(low))
        n = len(self.running.findall(paragraph))
        if n < 4:
            return False
        return (n >= LEAST_WORDS and k <= FUNCTION_SHARE * n) or (k == 0 and len(set(words)) <= 0.5 * len(words))

    def residue(self, text: str | None) -> str | None:
        if text is None or not text.strip():
            return None
        low = text.lower()
        if len(low) != len(text):  # a few letters change their length; positions must agree
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        hits: list[tuple[int, int]] = []
        slot = False
        for end, ids in self.machine.iter(low):
            for i in ids:
                if self.rules[i][0] == "slot":
                    slot = True
                else:
                    hits.append((end, i))
        if slot and self.slots(text):
            return "slot"
        starts, spans, at = [], [], 0
        for m in self.pieces.finditer(low):
            starts.append(at), spans.append((at, m.start()))
            at = m.end()
        starts.append(at), spans.append((at, len(low)))
        told: dict[int, str] = {}
        bodies: dict[int, str] = {}

        def body(k: int) -> str:
            if k not in bodies:
                bodies[k] = self.stamp.sub("", low[slice(*spans[k])]).strip()
            return bodies[k]

        for end, i in hits:
            k = bisect_right(starts, end) - 1
            kind, p = self.rules[i]
            if told.get(k) != "filler" and p.search(body(k)):
                told[k] = kind
        for k, (a, b) in enumerate(spans):
            if k in told:
                continue
            words = low[a:b].split()
            if len(words) >= 4 and len(set(words)) <= DISTINCT_SHARE * len(words):
                told[k] = "filler"
            elif len(words) <= 2:  # a page's number, perhaps after a time stamp; longer ones need a literal
                for i in self.always:
                    if self.rules[i][1].search(body(k)):
                        told[k] = self.rules[i][0]
        at = 0
        for m in (*self.gaps.finditer(text), None):
            end = m.start() if m else len(text)
            if end > at and self.meaningless(text[at:end], low[at:end]):
                for k in range(bisect_right(starts, at) - 1, bisect_right(starts, end - 1)):
                    told.setdefault(k, "filler")
            at = m.end() if m else end
        if not told:
            return None
        sizes = {"content": 0, "filler": 0, "page": 0}
        for k, (a, b) in enumerate(spans):
            kind = told.get(k, "content")
            if b > a and not FURNITURE.match(body(k)):
                sizes[kind] += len(body(k))
        every = sum(sizes.values())
        if sizes["filler"] and sizes["filler"] >= FILLER_SHARE * every:
            return "filler"
        if sizes["page"] and sizes["content"] <= CONTENT_SHARE * every:
            return "page"
        return None


def judge(documents: DataFrame, text: str = "text") -> DataFrame:
    """documents + ``residue``: 'slot', 'filler', 'page' or NULL for content.

    NULL and blank texts are no residue (there is nothing in them to exclude by this rule). Repeated rows are judged
    alike. Only the text travels to the function; the other columns, whatever their names, stay where they are.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        rules = Rules()
        for b in batches:
            yield pd.Series([rules.residue(x) for x in b], dtype="object")

    # Marked as not deterministic so that a filter on its result does not run it a second time.
    kind = F.pandas_udf(run, "string").asNondeterministic()
    return documents.withColumn("residue", kind(F.col(text)))


def without_residue(documents: DataFrame, text: str = "text") -> DataFrame:
    """The corpus without its residue."""
    return judge(documents, text).where("residue is null").drop("residue")


def p10_found(spark: SparkSession, base: str) -> DataFrame:
    docs = table(spark, base, "documents").select("doc_id", "text")
    return judge(docs).where("residue is not null and doc_id is not null").select("doc_id").distinct()


def p10_kinds(spark: SparkSession, base: str) -> DataFrame:
    """Documents by source and kind; texts are judged where they lie, and only ids and kinds are shuffled."""
    docs = table(spark, base, "documents").select("doc_id", "source", "text")
    judged = judge(docs).select("doc_id", "source", F.coalesce("residue", F.lit("content")).alias("kind")).dropDuplicates(["doc_id"])
    return judged.groupBy("source", "kind").agg(F.count("*").alias("n_docs"))


QUERIES = {"p10_found": p10_found, "p10_kinds": p10_kinds}
