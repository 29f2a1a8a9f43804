"""Text column expressions.

Tokens and sentences are regex extractions evaluated inside the JVM
(whole-stage codegen where Spark supports it); every per-token feature is
a higher-order function over the token array, so a text is tokenised once
per row.

Published rules (identical in Java regex and RE2):
  token    = letters/digits/underscore run with optional apostrophe
             suffixes, or one non-space, non-word character
  sentence = a run of non-terminators, then terminators or the end
These differ from NLTK on contractions and abbreviations.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# FIXED VALUES: tokenisation rules and character classes
TOKEN_PATTERN = r"[\p{L}\p{N}_]+(?:['’][\p{L}]+)*|[^\s\p{L}\p{N}_]"
SENTENCE_PATTERN = r"[^.!?]+(?:[.!?]+|$)"
# word characters as Python's \w sees them (Unicode letters, numbers, _);
# whitespace as Python's \s sees it (ASCII controls, FS..US, NEL, \p{Z})
SPECIAL_CHAR_CLASS = r"[^\p{L}\p{N}_\t\n\x0B\f\r\x1C-\x1F\x85\p{Z}]"
PUNCTUATION_CLASS = r"[.,;!?]"
VOWEL_GROUP = r"[aeiouy]+"
# FIXED VALUES: code points with Emoji=Yes in Unicode's emoji-data.txt (15.1),
# without the digits, # and *
EMOJI_RANGES = """
00A9 00AE 203C 2049 2122 2139 2194-2199 21A9-21AA 231A-231B 2328 23CF 23E9-23F3 23F8-23FA 24C2 25AA-25AB
25B6 25C0 25FB-25FE 2600-2604 260E 2611 2614-2615 2618 261D 2620 2622-2623 2626 262A 262E-262F 2638-263A 2640 2642
2648-2653 265F-2660 2663 2665-2666 2668 267B 267E-267F 2692-2697 2699 269B-269C 26A0-26A1 26A7 26AA-26AB 26B0-26B1
26BD-26BE 26C4-26C5 26C8 26CE-26CF 26D1 26D3-26D4 26E9-26EA 26F0-26F5 26F7-26FA 26FD 2702 2705 2708-270D 270F 2712
2714 2716 271D 2721 2728 2733-2734 2744 2747 274C 274E 2753-2755 2757 2763-2764 2795-2797 27A1 27B0 27BF 2934-2935
2B05-2B07 2B1B-2B1C 2B50 2B55 3030 303D 3297 3299 1F004 1F0CF 1F170-1F171 1F17E-1F17F 1F18E 1F191-1F19A 1F1E6-1F1FF
1F201-1F202 1F21A 1F22F 1F232-1F23A 1F250-1F251 1F300-1F321 1F324-1F393 1F396-1F397 1F399-1F39B 1F39E-1F3F0
1F3F3-1F3F5 1F3F7-1F4FD 1F4FF-1F53D 1F549-1F54E 1F550-1F567 1F56F-1F570 1F573-1F57A 1F587 1F58A-1F58D 1F590
1F595-1F596 1F5A4-1F5A5 1F5A8 1F5B1-1F5B2 1F5BC 1F5C2-1F5C4 1F5D1-1F5D3 1F5DC-1F5DE 1F5E1 1F5E3 1F5E8 1F5EF 1F5F3
1F5FA-1F64F 1F680-1F6C5 1F6CB-1F6D2 1F6D5-1F6D7 1F6DC-1F6E5 1F6E9 1F6EB-1F6EC 1F6F0 1F6F3-1F6FC 1F7E0-1F7EB 1F7F0
1F90C-1F93A 1F93C-1F945 1F947-1F9FF 1FA70-1FA7C 1FA80-1FA89 1FA8F-1FAC6 1FACE-1FADC 1FADF-1FAE9 1FAF0-1FAF8
"""
EMOJI_CLASS = "[" + "".join("-".join(rf"\x{{{x}}}" for x in r.split("-")) for r in EMOJI_RANGES.split()) + "]"
# every emoji is one of these
EMOJI_GUARD = r"[\xA9\xAE\x{203C}-\x{1FAF8}]"


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(TOKEN_PATTERN), 0)


def sentences(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(SENTENCE_PATTERN), 0)


def is_word(t: Column) -> Column:
    """Token is a word (starts with a letter, digit or underscore)."""
    return t.rlike(r"^[\p{L}\p{N}_]")


def syllables(t: Column) -> Column:
    """Vowel groups in the lower-cased token (textstat-style estimate)."""
    return F.regexp_count(F.lower(t), F.lit(VOWEL_GROUP))


def special_char_share(c: Column) -> Column:
    # whole runs of other characters are taken out, which costs less than finding each special one
    special = F.length(F.regexp_replace(c, f"[^{SPECIAL_CHAR_CLASS}]+", ""))
    return F.when(F.length(c) > 0, special / F.length(c))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` as a lambda variable.

    Spark does not share subexpressions inside lambdas: an array expression
    used inside ``transform(..., i -> ...)`` would be recomputed for every
    element.  Binding it through a one-element ``transform`` computes it once.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def ngrams(toks: Column, n: int, sep: str = "_") -> Column:
    """Contiguous n-grams joined by ``sep``; empty when fewer than n tokens."""
    def body(t):
        k = F.size(t) - n + 1
        # tokens by place, with no array for each n-gram
        return F.when(k >= 1, F.transform(F.slice(t, 1, F.greatest(k, F.lit(0))),
                                          lambda x, i: F.concat_ws(sep, x, *[F.get(t, i + j) for j in range(1, n)]))
                      ).otherwise(F.array().cast("array<string>"))
    return let(toks, body)


# FIXED VALUES: the English stop words that StopWordsRemover loads by default
ENGLISH_STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its
itself they them their theirs themselves what which who whom this that these those am is are was were be been being
have has had having do does did doing a an the and but if or because as until while of at by for with about against
between into through during before after above below to from up down in out on off over under again further then once
here there when where why how all any both each few more most other some such no nor not only own same so than too
very s t can will just don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd they'd i'm
you're he's she's it's we're they're i've we've you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't
doesn't didn't won't wouldn't shan't shouldn't mustn't can't couldn't cannot could here's how's let's ought that's
there's what's when's where's who's why's would
""".split()


def english_stop_words() -> list[str]:
    return ENGLISH_STOP_WORDS


def stop_array() -> Column:
    return F.array(*[F.lit(w) for w in english_stop_words()])
