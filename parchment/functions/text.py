"""Text functions as Column expressions; all run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from parchment.functions.matching import GREEK, NEGATIONS, OPPOSITES, PUNCTUATION, SCANS

#: Words that fill pauses, and the rule by which a spoken phrase replaces the one before.
FILLERS = "uh|um|erm|er|ah|hmm|mm+|uhh+|umm+"
NEAR, LEAST_WORDS, FEWER, MORE = 0.82, 5, 3, 5
#: Elements whose end is the end of a line.
BLOCKS = "h1|h2|h3|h4|h5|h6|p|li|div|tr|section|article|ol|ul"
#: White space as browsers know it, what is invisible, and letters printed as one sign.
SPACE = r"[\s\p{Z}\uFEFF]"
INVISIBLE = r"[\u200B\u200C\u200D\uFEFF\u00AD]"
LIGATURES = {"\ufb00": "ff", "\ufb01": "fi", "\ufb02": "fl", "\ufb03": "ffi", "\ufb04": "ffl", "\ufb05": "st", "\ufb06": "st"}


#: The signs of SPACE, one by one.
BLANKS = "".join(map(chr, (*range(0x09, 0x0E), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))


def stripped(text: Column) -> Column:
    """Without white space at both ends; one look at each sign, however long the runs of blanks inside."""
    return F.btrim(text, F.lit(BLANKS))


def word_list(text: Column) -> Column:
    """Words between white space; no empty ones."""
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


def words(text: Column) -> Column:
    return F.size(word_list(text))


def distinct_words(text: Column) -> Column:
    """Number of different words after lower-casing and dropping all but a-z, 0-9 and U+00C0 to U+024F."""
    folded = F.transform(word_list(F.lower(text)), lambda w: F.regexp_replace(w, "[^a-z0-9À-ɏ]", ""))
    return F.size(F.array_distinct(F.filter(folded, lambda w: w != "")))


def strip_html(html: Column) -> Column:
    """Tags to spaces, &nbsp; to a space, runs of white space to one space, trimmed."""
    plain = F.regexp_replace(F.regexp_replace(html, "<[^>]+>", " "), "&nbsp;", " ")
    return stripped(F.regexp_replace(plain, f"{SPACE}+", " "))


def collapse(text: Column) -> Column:
    """Each run of white space to one space; not trimmed."""
    return F.regexp_replace(text, f"{SPACE}+", " ")


def normalized(text: Column) -> Column:
    """As search sees a text: each run of white space one space (not trimmed), invisible signs gone, ligatures parted, quotes, dashes and dots
    in their plain form. Other compatibility forms are left to matching.Folded."""
    s = F.regexp_replace(F.regexp_replace(text, r"[\s\p{Z}]+", " "), INVISIBLE, "")
    for sign, letters in (*LIGATURES.items(), *((k, v) for k, v in PUNCTUATION.items() if len(v) > 1)):
        s = F.replace(s, F.lit(sign), F.lit(letters))
    single = [k for k, v in PUNCTUATION.items() if len(v) == 1]
    return F.translate(s, "".join(single), "".join(PUNCTUATION[k] for k in single))


def compact(text: Column) -> Column:
    """No white space at all; a hyphen at a line break before a lower-case letter goes too."""
    return F.regexp_replace(F.regexp_replace(text, rf"-(?={SPACE}*[\n\r]){SPACE}+(?=\p{{Ll}})", ""), f"{SPACE}+", "")


def tokens(text: Column) -> Column:
    """Words that start with a letter or number and go on with these, apostrophes and hyphens."""
    return F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}][\p{L}\p{N}'-]*)"), F.lit(1))


#: Where sentences part, leader marks at the start of a line, and what a video's address holds.
SENTENCE_END = r"(?<=[.!?])\s+(?=[A-Z(])"
LEADER = r"(^|\n)[ \t]*[.\-_=*~]{4,}(?=\s|[\p{L}\p{N}]|\z)"
VIDEO_PARAMETER, VIDEO_PATH = r"^[^?#]*\?(?:(?!v=)[^&#]*&)*v=([^&#]*)", r"(?:youtu\.be/|/embed/|/shorts/)([A-Za-z0-9_-]{11})"


def sentence_chunks(text: Column) -> Column:
    """Cut after . ! or ? and white space, before A-Z or an opening parenthesis."""
    return F.split(collapse(text), SENTENCE_END)


def occurrences(text: Column, needle: str) -> Column:
    """Number of occurrences that do not overlap."""
    return F.when(F.lit(needle) == "", 0).otherwise(((F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) / F.length(F.lit(needle))).cast("int"))


def alias_fold(text: Column) -> Column:
    """Greek letters to their names, hyphens dropped."""
    for letter, name in GREEK.items():
        text = F.replace(text, F.lit(letter), F.lit(name))
    return F.replace(text, F.lit("-"), F.lit(""))


def ocr_canonical(text: Column) -> Column:
    """Pairs of letters that scans confuse with one: rn, vv, cl, in this order."""
    for pair, one in SCANS:
        text = F.replace(text, F.lit(pair), F.lit(one))
    return text


def dictation_key(text: Column) -> Column:
    """Lower case, without words that fill pauses, all but letters and digits to spaces, collapsed and trimmed."""
    s = F.regexp_replace(F.lower(text), f"(?<![A-Za-z0-9_])({FILLERS})(?![A-Za-z0-9_])", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"[^\p{L}\p{N}\s\p{Z}\uFEFF]", " "), f"{SPACE}+", " "))


def replaces_phrase(before: Column, now: Column) -> Column:
    """Whether a phrase takes the place of the one before: both have enough words, share most of them and are about as
    long. Both are dictation keys; null counts as empty."""
    a, b = word_list(F.coalesce(before, F.lit(""))), word_list(F.coalesce(now, F.lit("")))
    n, m = F.size(a), F.size(b)
    return (n >= LEAST_WORDS) & (m >= LEAST_WORDS) & (set_similarity(a, b) >= NEAR) & (m >= n - FEWER) & (m <= n + MORE)


def needs_correction(text: Column) -> Column:
    """A dictation with words that fill pauses, four very short words in a row, or fourteen words."""
    key = dictation_key(text)
    filled = F.lower(text).rlike(f"(?<![A-Za-z0-9_])({FILLERS})(?![A-Za-z0-9_])")
    return F.coalesce((stripped(text) != "") & (filled | key.rlike(r"(?i)(?<![a-z0-9_])[a-z]{1,2}(?:\s+[a-z]{1,2}){3}(?![a-z0-9_])") | (words(key) >= 14)), F.lit(False))


def set_similarity(a: Column, b: Column) -> Column:
    """Common elements over the larger set; 0 if either is empty."""
    a, b = F.array_distinct(a), F.array_distinct(b)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b)))


def slug(text: Column, default: str = "untitled") -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit("")), F.lit(default))


def clock(seconds: Column) -> Column:
    """h:mm:ss, or m:ss below an hour; empty for 0 and null."""
    s = F.floor(seconds).cast("int")
    h, m = F.floor(s / 3600).cast("int"), F.floor(s % 3600 / 60).cast("int")
    return F.when(F.coalesce(seconds, F.lit(0)) == 0, "").when(h > 0, F.format_string("%d:%02d:%02d", h, m, s % 60)).otherwise(F.format_string("%d:%02d", m, s % 60))


def short_number(n: Column, unit: str = "views") -> Column:
    """1.2K views, 3.4M views; plain below a thousand, empty for 0 and null."""
    some = F.when(n >= 1e6, F.format_string("%.1fM", n / 1e6)).when(n >= 1e3, F.format_string("%.1fK", n / 1e3)).otherwise(n.cast("string"))
    return F.when(F.coalesce(n, F.lit(0)) == 0, "").otherwise(F.concat(some, F.lit(f" {unit}")))


def structured_text(html: Column) -> Column:
    """Ends of blocks and line breaks to new lines, tags to spaces, no spaces before a line's end, at most one blank line in a row."""
    s = F.regexp_replace(F.regexp_replace(html, f"(?i)</({BLOCKS})>", " \n"), r"(?i)<br\s*/?>", "\n")
    s = F.replace(F.replace(F.regexp_replace(s, "<[^>]+>", " "), F.lit("&nbsp;"), F.lit(" ")), F.lit("\r"), F.lit(""))
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n"), r"[ \t]{2,}", " ")
    return stripped(s)


def sentence_units(html: Column) -> Column:
    """The sentences of each paragraph of a marked-up text."""
    flat = F.transform(F.split(structured_text(html), r"\n{2,}"), lambda b: F.regexp_replace(b, r"\n+", " "))
    parts = F.flatten(F.transform(flat, lambda b: F.regexp_extract_all(b, F.lit(r"([^.!?]+[.!?]+|[^.!?]+\z)"), F.lit(1))))
    return F.filter(F.transform(parts, lambda x: stripped(x)), lambda x: x != "")


#: Marks of Markdown and what stands for them, in the order in which they go; as text, and as it is spoken. Pairs of equal marks are
#: written out as alternatives, as SQL engines have no references back.
MARKDOWN = (
    (r"```\s*([\s\S]*?)\s*```", "$1"), (r"(?m)^\s{0,3}#{1,6}\s*", ""), (r"(?m)^\s*>\s?", ""), (r"(?m)^\s*[-*+]\s+", ""), (r"(?m)^\s*\d+\.\s+", ""), (r"\[([^\]]+)\]\(([^)]+)\)", "$1"),
    (r"`([^`]+)`", "$1"), (r"\*\*\*(.*?)\*\*\*|___(.*?)___", "$1$2"), (r"\*\*(.*?)\*\*|__(.*?)__", "$1$2"), (r"\*(.*?)\*|_(.*?)_", "$1$2"), (r"(?m)^\s*---+\s*$", ""), (r"\n{3,}", "\n\n"),
)
SPOKEN = (
    (r"```[\s\S]*?```", ", code block,"), (r"`([^`]+)`", "$1"), (r"(?m)^#{1,6}\s+", ""), (r"\*{1,3}([^*]+)\*{1,3}", "$1"), (r"(?m)^\s*[-*]\s", ""), (r"(?m)^\s*\d+\.\s", ""),
    (r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"(?m)^>\s*", ""), (r"---+", ""), (r"\s+", " "),
)


def plain_markdown(text: Column) -> Column:
    """Markdown without its marks; links and code keep their text."""
    for pattern, stands in MARKDOWN:
        text = F.regexp_replace(text, pattern, stands)
    return stripped(text)


def spoken_markdown(text: Column) -> Column:
    """Markdown as it is read aloud: one line, without marks."""
    for pattern, stands in SPOKEN:
        text = F.regexp_replace(text, pattern, stands)
    return stripped(text)


def ocr_text(text: Column) -> Column:
    """Lines trimmed and joined by single spaces; empty ones go."""
    return stripped(F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\r"), F.lit("")), f"{SPACE}+", " "))


def selected(text: Column) -> Column:
    """A selection without runs of leader marks at the start of a line, spaces and blank lines tidied."""
    s = F.regexp_replace(text, LEADER, "$1")
    s = F.regexp_replace(F.regexp_replace(s, r"[ \t]+\n", "\n"), r"\n[ \t]+", "\n")
    return stripped(F.regexp_replace(F.regexp_replace(s, r"[ \t]{2,}", " "), r"\n{3,}", "\n\n"))


def video_id(url: Column) -> Column:
    """Parameter v of a url, else the id of 11 characters after a short, embedded or brief address; null without either or without a scheme."""
    given = F.nullif(F.regexp_extract(url, VIDEO_PARAMETER, 1), F.lit(""))
    path = F.nullif(F.regexp_extract(url, VIDEO_PATH, 1), F.lit(""))
    return F.when(url.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.coalesce(F.try_url_decode(given), given, path))


def initials(name: Column, default: str = "P") -> Column:
    """Capital first letters of the first two words."""
    letters = F.array_join(F.transform(F.slice(word_list(name), 1, 2), lambda w: F.upper(F.substring(w, 1, 1))), "")
    return F.coalesce(F.nullif(letters, F.lit("")), F.lit(default))


def lines_to_list(text: Column) -> Column:
    """Trimmed lines that are not empty."""
    return F.filter(F.transform(F.split(text, "\r?\n"), stripped), lambda s: s != "")


def noun_key(text: Column) -> Column:
    """Trimmed, lower case, single spaces, no final punctuation."""
    return F.regexp_replace(F.regexp_replace(F.lower(stripped(text)), f"{SPACE}+", " "), r"[.,;:]+\z", "")


def word_before(text: Column) -> Column:
    """The word a text ends in; empty if it does not end in one."""
    return F.regexp_extract(text, r"([\p{L}\p{N}'-]+)\z", 1)


def first_heading(markdown: Column) -> Column:
    return F.nullif(F.regexp_extract(markdown, r"(?m)^#{1,6}\s+(.+)$", 1), F.lit(""))


def context_before(text: Column, n: int = 1200) -> Column:
    """The first n characters, trimmed."""
    return stripped(F.substring(text, 1, n))


def selection_key(text: Column) -> Column:
    """As noun_key, but final punctuation goes before white space is tidied."""
    return stripped(F.regexp_replace(F.regexp_replace(F.lower(text), r"[.,;:]+\z", ""), f"{SPACE}+", " "))


def campaign_label(text: Column, default: str = "brand post") -> Column:
    return F.upper(F.replace(F.coalesce(F.nullif(text, F.lit("")), F.lit(default)), F.lit("-"), F.lit(" ")))


def plain_tags(html: Column) -> Column:
    """Tags to spaces; nothing else changes."""
    return F.regexp_replace(html, "<[^>]*>", " ")


def without_fence(text: Column) -> Column:
    """Without the fence of a code block around the whole text."""
    return stripped(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\A```[a-zA-Z0-9_-]*\n?", ""), r"\n?```\z", ""))


def listed(text: Column) -> Column:
    """The strings of the JSON array in a text (from its first opening to its last closing bracket), trimmed; null where there is none."""
    inside = F.regexp_extract(without_fence(text), r"(\[[\s\S]*\])", 1)
    return F.transform(F.from_json(F.nullif(inside, F.lit("")), "array<string>"), lambda x: stripped(F.coalesce(x, F.lit(""))))


def quoted(text: str) -> str:
    """A pattern that fits this text only."""
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def _first_parts(text: Column, key: str) -> tuple[Column, Column, Column]:
    """Whether a text holds `key` in any case, and what stands before and behind its first place; one scan from the start."""
    pattern = f"(?isu)\\A(.*?)({quoted(key)})"
    head = F.regexp_extract(text, pattern, 1)
    return text.rlike(f"(?iu){quoted(key)}"), head, text.substr(F.length(head) + F.length(F.regexp_extract(text, pattern, 2)) + 1, F.length(text))


def replace_first(text: Column, target: str, stands: str) -> Column:
    """The first place of `target`, in any case, replaced; a blank target changes nothing."""
    key = target.strip()
    if not key:
        return text
    hit, before, behind = _first_parts(text, key)
    return F.when(hit, F.concat(before, F.lit(stands), behind)).otherwise(text)


def single_spaced(text: Column) -> Column:
    """Runs of two or more blanks as one space."""
    return F.regexp_replace(text, f"{SPACE}{{2,}}", " ")


def delete_text(text: Column, target: str) -> Column:
    """Without the first place of `target` in any case and the white space around it; one space stays."""
    key = target.strip()
    if not key:
        return text
    hit, before, behind = _first_parts(text, key)
    left = F.concat(F.rtrim(before, F.lit(BLANKS)), F.lit(" "), F.ltrim(behind, F.lit(BLANKS)))
    return F.when(hit, single_spaced(left)).otherwise(text)


def _cut_end(text: Column, reversed_end: str) -> Column:
    """Without what the text ends in (white space apart), as a pattern for the reversed text: read from the end, so it is one scan whatever stands
    before. A space stands for what goes; where nothing fits, only runs of blanks change."""
    whole = F.rtrim(text, F.lit(BLANKS))
    end = F.length(F.regexp_extract(F.reverse(whole), reversed_end, 0))
    return single_spaced(F.when(end > 0, F.concat(F.rtrim(F.left(whole, F.length(whole) - end), F.lit(BLANKS)), F.lit(" "))).otherwise(text))


def without_last_word(text: Column) -> Column:
    return _cut_end(text, r"\A[^\s\p{Z}\uFEFF]+")


def without_last_sentence(text: Column) -> Column:
    """Without the sentence a text ends in, if it ends in one, a quote behind its stop or not."""
    return _cut_end(text, r"""\A["']?[.!?][^.!?]*""")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used, also for each element of an array."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def edit_recent(nodes: Column, hit: Callable[[Column], Column], change: Callable[[Column], Column], first: Column | None = None) -> Column:
    """An array of nodes of text with the most recent one that `hit` takes changed: the one numbered `first` (from 0; the node last dictated to) if it is hit, else the
    last that is. Blank and null nodes are never taken, but for `first`; without any hit nothing changes."""
    def edited(n: Column) -> Column:
        taken = F.transform(n, lambda x: F.coalesce(hit(x) & (stripped(x) != ""), F.lit(False)))
        at = F.size(n) - F.array_position(F.reverse(taken), F.lit(True)).cast("int")  # as many as there are nodes where none is taken
        if first is not None:
            at = F.when(F.coalesce(hit(F.get(n, first)), F.lit(False)), first).otherwise(at)
        return once(at, lambda k: F.transform(n, lambda x, i: F.when(i == k, change(x)).otherwise(x)))

    return once(nodes, edited)


def replace_recent(nodes: Column, target: str, stands: str, first: Column | None = None) -> Column:
    """replace_first() in the most recent node that holds `target` in any case; a blank target changes nothing."""
    key = target.strip()
    return edit_recent(nodes, lambda x: x.rlike(f"(?iu){quoted(key)}"), lambda x: replace_first(x, key, stands), first) if key else nodes


def delete_recent(nodes: Column, target: str, first: Column | None = None) -> Column:
    """delete_text() in the most recent node that holds `target` in any case."""
    key = target.strip()
    return edit_recent(nodes, lambda x: x.rlike(f"(?iu){quoted(key)}"), lambda x: delete_text(x, key), first) if key else nodes


def without_recent_word(nodes: Column, first: Column | None = None) -> Column:
    """without_last_word() of the most recent node that it changes."""
    return edit_recent(nodes, lambda x: without_last_word(x) != x, without_last_word, first)


def title_words(name: Column) -> Column:
    """snake_case to words that start with a capital; the rest of each word stays as it is."""
    words = F.split(F.coalesce(name, F.lit("")), "_")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000))), " ")


def escaped_html(text: Column) -> Column:
    for sign, stands in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(sign), F.lit(stands))
    return text


def draft_paragraphs(markdown: Column) -> Column:
    """Markdown as blocks of escaped lines; one empty block for nothing."""
    return once(plain_markdown(markdown), draft_blocks)


def draft_blocks(plain: Column) -> Column:
    """draft_paragraphs() of Markdown that has lost its marks."""

    def blocks(parts: Column) -> Column:
        divs = F.transform(parts, lambda p: F.concat(F.lit("<div>"), F.array_join(F.transform(F.split(p, "\n"), escaped_html), "<br />"), F.lit("</div>")))
        return F.when(F.size(parts) > 0, F.array_join(divs, "")).otherwise("<div><br></div>")

    return once(F.filter(F.transform(F.split(plain, r"\n{2,}"), stripped), lambda p: p != ""), blocks)


def flag_of(label: Column) -> Column:
    """What stands before the first white space."""
    return F.regexp_extract(label, r"^(\S+)", 1)


def country_of(label: Column) -> Column:
    """A label without its flag and its dialling code in brackets."""
    return F.regexp_replace(F.regexp_replace(label, r"^\S+\s", ""), r"\s*\(\+\d+\)\z", "")


def asset_kind(url: Column, format: Column) -> Column:
    film = F.lower(F.coalesce(url, F.lit(""))).rlike(r"\.(mp4|mov|m4v|webm)(\?|\z)") | (F.lower(stripped(F.coalesce(format, F.lit("")))) == "reel")
    return F.when(film, "video").otherwise("image")


def preset_of(format: Column) -> Column:
    f = F.lower(F.coalesce(format, F.lit("")))
    return F.when(f.contains("story") | f.contains("reel"), "story").when(f.contains("single"), "square").otherwise("portrait")


def first_place(text: Column, spoken: Column) -> Column:
    """Where `spoken` is found in any case: struct(start from 0, end), else null."""
    at = F.locate(F.lower(spoken), F.lower(text)) if isinstance(spoken, str) else F.instr(F.lower(text), F.lower(spoken))
    return F.when(at > 0, F.struct((at - 1).alias("start"), (at - 1 + F.length(spoken)).alias("end")))


#: What a host says of files that are too large, sounds and the shapes of a mouth, how a name is spoken.
TOO_LARGE = "(?i)cloudinary|file size|too large|payload too large|maximum|max size|limit exceeded"
NAME_SPOKEN = ("(?i)AMCTOSHS", "Amek Tosh Ess")
SILENT = "mouthClose"


def is_size_error(message: Column, status: Column) -> Column:
    return F.coalesce(status == 413, F.lit(False)) | F.coalesce(message, F.lit("")).rlike(TOO_LARGE)


def speakable(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), *NAME_SPOKEN)


def viseme(code: Column, shapes: dict[str, str]) -> Column:
    """The shape of a sound by its code in any case; closed for unknown ones and none."""
    table = F.create_map(*(F.lit(x) for pair in shapes.items() for x in pair))
    return F.coalesce(F.element_at(table, F.upper(code)), F.lit(SILENT))


def list_marker(ordered: Column, style: Column, index: Column) -> Column:
    """A bullet, a letter or a number; index from 0."""
    letter = F.concat(F.char(97 + index % 26), F.lit("."))
    return F.when(~ordered, "\u2022").when(F.lower(F.coalesce(style, F.lit(""))).contains("alpha"), letter).otherwise(F.concat((index + 1).cast("string"), F.lit(".")))


def arabic_share(html: Column) -> Column:
    """Arabic letters among all Latin and Arabic ones; 0 without letters."""
    s = strip_html(F.coalesce(html, F.lit("")))
    n = F.regexp_count(s, F.lit(r"[A-Za-z\u0600-\u06FF]"))
    return F.when(n == 0, 0.0).otherwise(F.regexp_count(s, F.lit(r"[\u0600-\u06FF]")) / n)


def markdown_counts(markdown: Column) -> Column:
    """struct(words, chars) of Markdown without its marks."""
    return once(plain_markdown(markdown), lambda s: F.struct(words(s).alias("words"), F.length(s).alias("chars")))


def trimmed_list(text: Column, by: str = ",") -> Column:
    """Parts between separators, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, by), stripped), lambda x: x != "")


def joined_captures(texts: Column, most: int) -> Column:
    """Texts that are not blank, trimmed, a blank line between them, cut to `most` characters."""
    some = F.filter(F.transform(texts, lambda t: stripped(F.coalesce(t, F.lit("")))), lambda t: t != "")
    return F.left(F.array_join(some, "\n\n"), F.lit(most))


def opposite(a: Column, b: Column) -> Column:
    """Whether two words begin with prefixes that turn the meaning round."""
    out = F.lit(False)
    for x, y in OPPOSITES:
        out = out | (a.startswith(x) & b.startswith(y)) | (a.startswith(y) & b.startswith(x))
    return out


def negation_differs(a: Column, b: Column) -> Column:
    """Whether one of two lists of words holds a negation and the other does not."""
    words = F.array(*map(F.lit, sorted(NEGATIONS)))
    return F.arrays_overlap(a, words) != F.arrays_overlap(b, words)


def similarity_of(distance: Column, a: Column, b: Column) -> Column:
    """1 less a distance over the longer length; never below 0."""
    return F.greatest(F.lit(0.0), 1 - distance / F.greatest(F.length(a), F.length(b), F.lit(1)))
