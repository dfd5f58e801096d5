"""Text heuristics as column expressions; every function takes and returns columns and maps null to null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bullets, linking words, mathematical words, stop words by language, as they decide results.
BULLETS = "•▪▫◦‣·∙●○–—"
LINKING_WORDS = "of the and or a an in on for to with by at de del la el los las y o e en con por para du des le les et au aux di della il und der die".split()
MATH_WORDS = "sin cos tan cot sec csc sinh cosh tanh log ln exp lim max min det arg mod div sup inf dim gcd lcm".split()
STOP_WORDS = {
    "es": "de la que el en los del las por con para una como es se no su al lo mas".split(),
    "en": "the of and to in that for was with as on by at from this which were has been not".split(),
    "fr": "le de la les des et en un une dans pour que qui sur pas plus par au aux est".split(),
    "de": "der die und den des das von mit dem ist im nicht auch eine einer auf sich als wurde durch".split(),
    "pt": "de que nao para com uma dos das por mais como foi pelo pela sao seu sua isso mas ja".split(),
    "it": "di che il la per non una con del della sono come piu anche nel alla gli questo essere stato".split(),
}
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
WIDE_SPACES, NO_WIDTH = "     ", "​­"
SUPERSCRIPTS = ("⁰¹²³⁴⁵⁶⁷⁸⁹", "0123456789")
PROSE_SAFE = "∞±∓×÷≠≤≥≈≡→°·½⅓⅔¼¾⅕⅖⅗⅘⅙⅚⅛⅜⅝⅞⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾ⁿⁱ₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎"
MATH_SYMBOLS = (
    "αβγδεζηθικλμνξπρστυφχψωΓΔΘΛΞΠΣΥΦΨΩ½⅓⅔¼¾⅕⅖⅗⅘⅙⅚⅛⅜⅝⅞∫∬∭∮∑∏√∛∜∞±∓×÷≠≤≥≈≡∈∉⊂⊆∪∩∅∇∂→⇒⇔∀∃∄°·∝∠⊥⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾ⁿⁱ₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎"
)
PAGE_NUMBER = r"^(?:[-–—|\s]*\d{1,4}[-–—|\s]*|(?:p[áa]g(?:ina)?\.?|page|pag\.?)\s*\d{1,4}(?:\s*(?:de|of|/)\s*\d{1,4})?|\d{1,4}\s*(?:de|of|/)\s*\d{1,4})$"
CODE_SYNTAX = r"[{};]\s*$|^\s*(?:def|class|import|function|var|let|const|elif|#include|#define)\s+\w|==|!=|=>|->|::|\+=|\$\(|</?[a-z]+[ >]|\w\(.*\)\s*[:{;]?\s*$"
#: Characters a page number line has at most; words a language vote needs, looks at, and its two gates.
PAGE_NUMBER_CHARS = 24
VOTE_WORDS, VOTE_SAMPLE, VOTE_SHARE, VOTE_LEAD = 40, 4000, 0.02, 1.25


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def one_line(c: Column) -> Column:
    """White-space runs as one space, none at the ends."""
    return strip(F.regexp_replace(c, r"\s+", " "))


def normalise(c: Column) -> Column:
    """Searchable text: a soft hyphen at a word's end becomes a hyphen; control characters go; ligatures, odd spaces
    and the non-breaking hyphen become plain. Superscripts stay, being footnote calls."""
    c = F.regexp_replace(c, r"([\p{L}\p{N}_])­(?=\s|$)", "$1-")
    c = F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    c = F.translate(c, WIDE_SPACES + "‑" + NO_WIDTH, " " * len(WIDE_SPACES) + "-")
    for a, b in LIGATURES.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def repetition_key(c: Column, with_numbers: bool = False) -> Column:
    """What makes two running lines equal: letters only if they are 15 or more, else letters and digits."""
    low = F.lower(c)
    whole = F.regexp_replace(low, r"[^\p{L}\p{N}]+", "")
    if with_numbers:
        return whole
    letters = F.regexp_replace(low, r"[^\p{L}]+", "")
    return F.when(F.length(letters) >= 15, letters).otherwise(whole)


def is_page_number(c: Column) -> Column:
    s = strip(c)
    return (s != "") & (F.length(s) <= PAGE_NUMBER_CHARS) & s.rlike("(?iu)" + PAGE_NUMBER)


def looks_tabular(c: Column) -> Column:
    """Two pipes, or two gaps of two spaces and more between words."""
    s = strip(c)
    pipes = F.length(s) - F.length(F.replace(s, F.lit("|"), F.lit("")))
    return (pipes >= 2) | (F.regexp_count(s, F.lit(r"\S {2,}\S")) >= 2)


def is_list_item(c: Column) -> Column:
    return strip(c).rlike(rf"^[{BULLETS}\-*]|^\d+[.)]|^[a-zA-Z][.)]\s+|^\([a-zA-Z0-9]+\)")


def is_quote(c: Column) -> Column:
    return strip(c).rlike("^[>»] ")


def normal_bullet(c: Column) -> Column:
    """A typographic bullet at the start of a line as ``- ``."""
    return F.regexp_replace(c, rf"^(\s*)[{BULLETS}\-*]\s*", "$1- ")


def ends_cut(c: Column) -> Column:
    """A heading that ends in a linking word, a comma or a hyphen, or has no word: a piece of something longer."""
    words = F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}+"), F.lit(0))
    return (F.size(words) == 0) | F.try_element_at(words, F.lit(-1)).isin(LINKING_WORDS) | F.regexp_replace(c, r"\s+$", "").rlike("[,-]$")


def looks_like_code(lines: Column) -> Column:
    """An array of lines of which two, and three in ten, have the syntax of a program."""
    full = F.filter(lines, lambda x: strip(x) != "")
    code = F.size(F.filter(full, lambda x: x.rlike(CODE_SYNTAX)))
    return (code >= 2) & (code >= 0.3 * F.size(full))


def useful_title(title: Column, filename: Column) -> Column:
    """A metadata title that says something: not too short, no default of a word processor, not the file's name."""
    s = F.lower(strip(title))
    stem = F.lower(F.regexp_replace(F.coalesce(filename, F.lit("")), r"\.[A-Za-z0-9]+$", ""))
    return F.coalesce((F.length(s) >= 4) & ~s.rlike(r"^(?:microsoft word|untitled|document\d+$|title$)|\.(?:docx?|pdf)$") & (s != stem), F.lit(False))


def prose_words(c: Column) -> Column:
    """Words of three letters and more that are no mathematical function."""
    words = F.regexp_extract_all(F.lower(c), F.lit("[a-záéíóúüñ]{3,}"), F.lit(0))
    return F.size(F.filter(words, lambda w: ~w.isin(MATH_WORDS)))


def has_math(c: Column) -> Column:
    return c.rlike(f"[{MATH_SYMBOLS}]")


def is_formula(c: Column) -> Column:
    s = strip(c)
    return (s != "") & (prose_words(s) == 0) & (has_math(s) | s.contains("="))


def note_marker(c: Column) -> Column:
    """Superscript digits as plain ones."""
    return F.translate(strip(c), *SUPERSCRIPTS)


def heading_level(text: Column, size: Column, body: Column, bold: Column, ratio: float = 1.15) -> Column:
    """1 to 3 for a heading by its size against the body or by capitals, else 0."""
    s = strip(text)
    letters = F.length(F.regexp_replace(s, r"[^\p{L}]", ""))
    by_size = F.when(size >= 1.55 * body, 1).when(size >= 1.25 * body, 2).otherwise(3)
    capitals = ~s.rlike(r"\p{Ll}") & s.rlike(r"\p{Lu}") & F.length(s).between(4, 99) & ~F.substring(s, 1, 2).rlike(r"\d")
    return F.when(letters < 2, 0).when((size >= ratio * body) & (F.length(s) < 160), by_size).when(capitals, F.when(bold, 2).otherwise(3)).otherwise(0)


def vote_words(c: Column) -> Column:
    """The runs of plain letters that a language vote is over."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0))


def vote_of(words: Column) -> Column:
    """The language most stop words of an array of words are of; empty for few words and where none stands out.

    Only the first VOTE_SAMPLE words are looked at, as the results to be met are defined; ties go to the language first in
    STOP_WORDS. ``words`` should be a column of its own, so that it is made once."""
    looked = F.slice(words, 1, VOTE_SAMPLE)

    def votes_of(stop: list[str]) -> Column:
        return F.size(F.filter(looked, lambda w: w.isin(stop)))

    votes = [F.struct(votes_of(stop).alias("n"), F.lit(-i).alias("i"), F.lit(x).alias("lang")) for i, (x, stop) in enumerate(STOP_WORDS.items())]
    order = F.array_sort(F.array(*votes))
    best, second = F.element_at(order, -1), F.element_at(order, -2)
    sure = (F.size(words) >= VOTE_WORDS) & (best["n"] >= VOTE_SHARE * F.size(looked)) & ((second["n"] == 0) | (best["n"] >= VOTE_LEAD * second["n"]))
    return F.when(words.isNull() | ~sure, F.lit("")).otherwise(best["lang"])


def language_vote(c: Column) -> Column:
    """:func:`vote_of` the words of a text; null text is empty."""
    return F.when(c.isNull(), F.lit("")).otherwise(F.element_at(F.transform(F.array(vote_words(c)), vote_of), 1))


def yaml_quoted(c: Column) -> Column:
    s = F.replace(F.replace(one_line(c), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), s, F.lit('"'))


def yaml_unquoted(c: Column) -> Column:
    inner = F.regexp_replace(strip(c), r'^"|"$', "")
    return F.replace(F.replace(inner, F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))


def yaml_list(c: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(c, yaml_quoted), ", "), F.lit("]"))


def escape_heading(c: Column) -> Column:
    """A # at the very start that is no heading, escaped."""
    return F.regexp_replace(c, r"^(#{1,6}\s)", r"\\$1")


def markdown_url(c: Column) -> Column:
    """An address with parentheses, spaces or angle brackets in angle brackets."""
    return F.when(c.rlike("[() <>]"), F.concat(F.lit("<"), F.replace(c, F.lit(">"), F.lit("%3E")), F.lit(">"))).otherwise(c)


def slug(c: Column, default: str = "document", length: int = 80) -> Column:
    """ASCII name of lower-case words joined by hyphens, cut at ``length``; ``default`` if nothing is left.

    Letters with marks lose them by translation of the Latin alphabets; other characters separate words."""
    import unicodedata

    marked = [chr(i) for i in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if len(d := unicodedata.normalize("NFKD", chr(i))) > 1 and d[0].isascii() and d[0].isalnum() and all(unicodedata.combining(x) for x in d[1:])]
    plain = "".join(unicodedata.normalize("NFKD", x)[0] for x in marked)
    s = F.translate(F.regexp_replace(c, "[̀-ͯ]", ""), "".join(marked), plain)
    s = F.regexp_replace(s, "['‘’ʼ\"“”`]", "")
    s = F.regexp_replace(F.lower(F.trim(F.regexp_replace(s, "[^A-Za-z0-9]+", " "))), " ", "-")
    s = F.regexp_replace(F.substring(s, 1, length), "-+$", "")
    return F.when(s.isNull() | (s == ""), default).otherwise(s)


def visible_path(c: Column) -> Column:
    """A Windows path without its long-path prefix."""
    return F.regexp_replace(F.regexp_replace(c, r"^\\\\\\\\\?\\\\UNC\\\\", r"\\\\\\\\"), r"^\\\\\\\\\?\\\\", "")


def search_hits(c: Column, needle: str) -> Column:
    """Non-overlapping hits of a phrase without regard to case; 0 for an empty phrase."""
    if not needle:
        return F.lit(0)
    low = F.lower(c)
    return ((F.length(low) - F.length(F.replace(low, F.lit(needle.lower()), F.lit("")))) / len(needle)).cast("int")
