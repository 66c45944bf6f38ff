"""What can be looked for: a small dimension of targets, resolved on the driver.

Patterns are Java regular expressions. Letters and word ends mean the ASCII
ones, so they are spelt out: Java's own word boundary looks at Unicode letters.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from inkveil.errors import UnknownTarget

LETTER = "[A-Za-z0-9_]"
#: A place between a word character and something else, in either order.
EDGE = f"(?:(?<={LETTER})(?!{LETTER})|(?<!{LETTER})(?={LETTER}))"

# Hosts of personal profiles, and endings that make a bare host an address.
PROFILE_HOSTS = (
    "linkedin.com", "github.com", "gitlab.com", "bitbucket.org", "twitter.com", "x.com", "behance.net",
    "dribbble.com", "medium.com", "stackoverflow.com", "kaggle.com", "instagram.com", "facebook.com", "t.me",
    "linktr.ee", "bento.me", "beacons.ai", "carrd.co", "about.me", "bio.link", "substack.com", "dev.to",
    "hashnode.dev", "leetcode.com", "hackerrank.com", "codeforces.com", "codechef.com", "npmjs.com",
    "producthunt.com", "youtube.com", "threads.net", "mastodon.social", "bsky.app",
)
BARE_ENDINGS = (
    "com", "org", "net", "edu", "gov", "io", "dev", "ai", "me", "co", "in", "uk", "us", "eu", "app", "xyz", "tech",
    "space", "site", "online", "live", "page", "link", "blog", "cloud", "digital", "ee", "sh", "gg", "so", "to",
)

# The shapes of identifiers.
# A search starts at the beginning of a run of letters or where the last match ended, which finds the same and reads a run once.
EMAIL = r"(?i)(?:\G|(?<![A-Z0-9._%+-]))[A-Z0-9._%+-]++\s?@\s?[A-Z0-9.-]+\.[A-Z]{2,}"
# With 26 digits ahead no end within reach is a word's end.
PHONE = r"(?:\+[0-9]{1,3}[\s.-]?)?(?:\([0-9]{1,4}\)[\s.-]?)?(?![0-9]{26})[0-9]{2,5}(?:[\s.-]?[0-9]{2,5}){1,4}" + EDGE
SOCIAL = rf"(?i){EDGE}(?:https?://)?(?:[a-z]{{2,3}}\.)?(?:{'|'.join(h.replace('.', '[.]') for h in PROFILE_HOSTS)})/[^\s<>\"')]*"
DOB = (
    rf"(?i){EDGE}(?:d\.?o\.?b\.?|date\s+of\s+birth|born){EDGE}[^\n]{{0,40}}"
    rf"|{EDGE}(?:0?[1-9]|[12][0-9]|3[01])[/.\-](?:0?[1-9]|1[0-2])[/.\-](?:19|20)[0-9]{{2}}{EDGE}"
)
URL_EXPLICIT = rf"(?i){EDGE}(?:https?://|www\.)[^\s<>\"')\]]+"
# Labels that begin and end with a letter or digit, each with its dot: a run of single signs in which no dot
# stands beside a dot or a hyphen. A repeated group of labels would recurse once a label.
_HOST = r"(?<![@A-Za-z0-9_.-])[a-z0-9](?:[a-z0-9.-](?<![.][.-]|-[.]))*(?<=[a-z0-9])[.]"
URL_PATH = rf"(?i){_HOST}[a-z]{{2,}}/[^\s<>\"')\]]*"
URL_BARE = rf"(?i){_HOST}(?:{'|'.join(BARE_ENDINGS)}){EDGE}"
URLS = (URL_EXPLICIT, URL_PATH, URL_BARE)
#: Every address has one of these: one with a scheme needs no dot.
URL_SIGNS = (".", "://")


@dataclass(frozen=True)
class Target:
    """One kind of identifier. ``needs`` has strings of which every match of the patterns has one; none means any text."""

    id: str
    description: str
    patterns: tuple[str, ...] = ()
    visual_only: bool = False
    needs: tuple[str, ...] = ()

    def __post_init__(self):
        if "+" in self.id or not self.id:
            raise UnknownTarget(f"a target id must be non-empty and free of '+': {self.id!r}")


_TARGETS = (
    Target("name", "What the person is called, wherever it stands on the page."),
    Target("email", "Electronic mail addresses.", (EMAIL,), needs=("@",)),
    Target("phone", "Numbers at which the person can be called, with any prefix.", (PHONE,)),
    Target("address", "Where the person lives, down to single parts of it that stand alone."),
    Target("social", "Pages and handles that the person has on other sites.", (SOCIAL,), needs=("/",)),
    Target("url", "Web addresses.", URLS, needs=URL_SIGNS),
    Target("photo", "A picture of the person's face or figure.", visual_only=True),
    Target("signature", "Handwriting with which the person signs.", visual_only=True),
    Target("dob", "When the person was born, or how old they are.", (DOB,)),
    Target("nationality", "Which state the person belongs to or comes from, and what allows them to work."),
    Target("gender", "Words that tell the person's sex, such as a form of address."),
    Target("marital_status", "Who the person lives with: spouse, children, single or not."),
    Target("employer", "Which firms and bodies the person has worked at; what they did there is no part of it."),
    Target("school", "Where the person was taught; what they learned there is no part of it."),
    Target("reference", "Other people who vouch for the person, and how to reach them."),
)
BUILTIN = {t.id: t for t in _TARGETS}


def builtin_target_ids() -> list[str]:
    return list(BUILTIN)


def resolve_targets(wanted: Iterable[str | Target]) -> list[Target]:
    """Targets in the order asked for; of equal ids the first counts. Unknown ids fail before anything is read."""
    found: dict[str, Target] = {}
    for item in wanted:
        target = BUILTIN.get(item) if isinstance(item, str) else item
        if target is None:
            raise UnknownTarget(f'Unknown target "{item}". Known targets: {", ".join(BUILTIN)}. Pass a Target to define your own.')
        found.setdefault(target.id, target)
    return list(found.values())
