"""Patterns and rules for collections about computers.

All patterns below are fixed values. Patterns that would backtrack over long runs
use possessive quantifiers: they match the same text as their plain forms but take
linear time and no regex stack, however long a template, sentence or word is.
"""

from __future__ import annotations

from wikisift.functions.attributes import Attribute, Source

# Page names and content that are not articles.
SKIPPED_NAME_PREFIXES = ("Category:", "Category_talk:", "Special:")
REDIRECT_MARK = "wgInternalRedirectTargetUrl"

# Category patterns for the dump and the site.
DUMP_ALLOW = r"computers|(?<!word )processor|game consoles"
DUMP_DENY = (
    "fashion|people|theoretical computer science|companies|algorithm|programming constructs"
    "|architecture statements|book|video game(?! consoles)|jargon|comic|culture"
    "|lists? |operating system|system administration|characters in"
)
SITE_ALLOW = "(?i)system|processor|computer|mainframe|unibus"
SITE_DENY = (
    "(?i)operating system|file system|software|manufacturer|documentation|families|interface| basics"
)

# Building blocks of the value patterns.
LINK = r"\[\[([^|\]]*?)(?:\|.*?)?\]\]"
ENTITY = LINK + r"|= ([\w- ]+)"
DATE = r"(?:\d{1,2} )?(?:[A-Za-z]+ )?(\d{4})"
UNIT = r"(?:\[\[)?(?:Hertz\|)?([MGk]Hz)"
NUMBER = r"\d+(?:\.\d+)?"
CLOCK = rf"(?<!\d)(\d++(?:\.\d++)?) *(?:&nbsp; *)?{UNIT}"

# Segments. A template field runs over lines, balanced {{...}} and [[...]].
INFOBOX_FIELD = (
    r"(?:^|\n)\| *+[^\n=]*+="
    r"(?:[^|\n{\[]*+(?:\{\{(?:[^}\r\x{85}\x{2028}\x{2029}]|\}(?!\}))*+\}\}|\[\[.*?\]\])? *+,?+)++"
)
CATEGORY_LINK = r"\[\[Category:(.*?)[\]|]"
_WORDS = r"(?: ?[^\n.{\[ ]++(?:\.\d++)?| \[\[[^\]]*+\]\]| ?\{\{[^}]*+\}\})++"
SENTENCE = rf"(?<!\{{\{{)[A-Z](?:[a-zA-Z]*+{_WORDS}|(?:[a-zA-Z](?=[a-zA-Z]))*+{_WORDS})"

# The rules.
COMPUTERS = (
    Source(
        segment=INFOBOX_FIELD,
        attributes=(
            Attribute("release", r"(?:release\w*(?: date)?|produced-start) *=", r"(\d{4})"),
            Attribute("discontinued", r"(?:discontinued|produced-end) *=", r"(\d{4})"),
            Attribute("wordSize", r"data-width *=", r"(\d+)", multiple=True),
            Attribute("wordSize", r"(?:platform|bits) *=", r"(\d+)-bit", multiple=True),
            Attribute("company", r"manuf(?:1|acturer) *=", ENTITY, multiple=True),
            Attribute("company", r"(?:developer|designfirm|designer) *=", ENTITY, multiple=True),
            Attribute("company", r"owner *=", ENTITY, multiple=True),
            Attribute("company", r"soldby *=", ENTITY, multiple=True),
            Attribute(
                "clockSpeed", r"(?:cpu|processor|frequency) *=", CLOCK, multiple=True, concat=True
            ),
            Attribute(
                "clockSpeed",
                value=rf"\| *slowest *= *({NUMBER}) *\| *slow-unit *= *{UNIT}",
                multiple=True,
                concat=True,
            ),
        ),
    ),
    Source(
        segment=CATEGORY_LINK,
        attributes=(
            Attribute("tech", "Vacuum tube computers", explicit="vacuum-tubes"),
            Attribute("tech", "Electro-mechanical computers", explicit="electro-mechanical"),
            Attribute("tech", "Serial computers", explicit="serial"),
        ),
    ),
    Source(
        attributes=(
            Attribute("wordSize?", value=r"\[\[(\d+)-bit"),
            Attribute("wordSize?", value=r"(?<!\w)(\w++)-bit (?:word|processor|microprocessor)"),
            Attribute("clockSpeed?", value=CLOCK, multiple=True, concat=True),
        ),
    ),
    Source(
        segment=SENTENCE,
        all_attributes=True,
        attributes=(
            Attribute(
                "company?",
                value=r"(?:sold|launched|introduced|developed) (?:.{0,20}? )?by.{0,20}?" + LINK,
                children=(Attribute("release", value=rf"(?:in|on) {DATE}"),),
                contains="[[",
            ),
            Attribute(
                None,
                predicate="released in",
                children=(Attribute("release?", value=rf"(?:in|on) {DATE}", multiple=True),),
            ),
        ),
    ),
)
