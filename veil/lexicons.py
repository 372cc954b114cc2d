"""Word lists. The short ones are stated here; the long ones are parameters.

``Lexicons()`` carries public lists of frequent given names and of function words, and a few words of
letters. A deployment passes its own full lists, from Python or from one-column tables::

    Lexicons.from_tables(spark, first_names="s3://.../names", stopwords="s3://.../words")

The 2,048-word wallet list is likewise a table handed to ``operators.secrets.seed_phrases``.
"""

from __future__ import annotations

import calendar
from dataclasses import dataclass, field

# Titles that introduce a name.
HONORIFICS = (
    "mr mrs ms miss mx dr prof professor sir madam dame rev reverend hon fr capt col sgt lt gen"
).split()

# Surnames too ordinary to be searched for on their own.
SWEEP_STOPWORDS = (
    "cook baker smith brown green white black young king price rose hunter walker carter fisher gardener mason "
    "miller turner taylor wood field hill moore shaw stone wolf fox bell"
).split()

# The most frequent given names of the last hundred years in the United States, men's then women's, in the order of the Social
# Security Administration's public table. A default that says where it comes from, not a list of all names.
COMMON_FIRST_NAMES = (
    "james michael robert john david william richard joseph thomas christopher charles daniel matthew anthony mark "
    "steven donald andrew joshua paul kenneth kevin brian timothy ronald jason george edward jeffrey ryan jacob "
    "nicholas gary eric jonathan stephen larry justin benjamin scott brandon samuel gregory alexander patrick frank "
    "jack raymond dennis tyler aaron jerry jose nathan adam henry zachary douglas peter noah kyle ethan christian "
    "jeremy keith austin sean roger terry walter dylan gerald carl jordan bryan gabriel jesse harold lawrence logan "
    "arthur bruce billy elijah joe alan juan liam willie mason albert randy wayne vincent lucas caleb luke bobby "
    "isaac bradley "
    "mary patricia jennifer linda elizabeth barbara susan jessica karen sarah lisa nancy sandra ashley emily kimberly "
    "betty margaret donna michelle carol amanda melissa deborah stephanie rebecca sharon laura cynthia dorothy amy "
    "kathleen angela shirley emma brenda pamela nicole anna samantha katherine christine debra rachel carolyn janet "
    "maria olivia heather helen catherine diane julie victoria joyce lauren kelly christina ruth joan virginia judith "
    "evelyn hannah andrea megan cheryl jacqueline madison teresa abigail sophia martha sara gloria janice kathryn ann "
    "isabella judy charlotte julia grace amber alice jean denise frances danielle marilyn natalie beverly diana "
    "brittany theresa kayla alexis doris lori tiffany"
).split()

# Function words, in the order of the Snowball project's public English list.
FUNCTION_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it "
    "its itself they them their theirs themselves what which who whom this that these those am is are was were be been "
    "being have has had having do does did doing would should could ought a an the and but if or because as until while "
    "of at by for with about against between into through during before after above below to from up down in out on off "
    "over under again further then once here there when where why how all any both each few more most other some such no "
    "nor not only own same so than too very"
).split()
# Words this package's authors met beside names in letters and forms.
LETTER_WORDS = (
    "please thanks greetings sincerely cheers enclosed attached urgent fwd subject "
    "bank hospital university college airport hotel ministry library museum church "
    "form letter receipt statement contract schedule appendix chapter paragraph column"
).split()
CALENDAR_WORDS = [w.lower() for w in (*calendar.day_name, *calendar.month_name) if w]


@dataclass(frozen=True)
class Lexicons:
    first_names: tuple[str, ...] = field(default_factory=lambda: tuple(COMMON_FIRST_NAMES))
    stopwords: tuple[str, ...] = field(default_factory=lambda: tuple(dict.fromkeys(FUNCTION_WORDS + LETTER_WORDS + HONORIFICS + CALENDAR_WORDS)))
    honorifics: tuple[str, ...] = field(default_factory=lambda: tuple(HONORIFICS))
    sweep_stopwords: tuple[str, ...] = field(default_factory=lambda: tuple(SWEEP_STOPWORDS))

    MAX_WORDS = 100_000  # lists become literals of the plan; a lexicon is thousands of words, not a corpus

    @classmethod
    def from_tables(cls, spark, first_names: str | None = None, stopwords: str | None = None) -> "Lexicons":
        """Read word lists from parquet tables with one string column each."""

        def words(path):
            rows = spark.read.parquet(path).limit(cls.MAX_WORDS + 1).collect()
            if len(rows) > cls.MAX_WORDS:
                raise ValueError(f"{path} holds more than {cls.MAX_WORDS} words")
            return tuple(sorted({r[0].strip().lower() for r in rows if r[0]}))

        given = {}
        if first_names:
            given["first_names"] = words(first_names)
        if stopwords:
            given["stopwords"] = words(stopwords)
        return cls(**given)
