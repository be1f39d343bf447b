"""Patterns of the text pipeline, in two spellings.

``PORTABLE`` spellings use only what linear-time regex engines offer and are what the SQL oracles run.
``JVM`` spellings match the same strings but cannot overflow the stack or go quadratic in ``java.util.regex``:
groups are possessive, and an address may only start where its run of characters starts (or where the last match ended).
"""

from __future__ import annotations

# They must equal the reference's for right results.
PAYLOAD_MARKER = "\ufffd\ufffd\ufffd\ufffd\x01\x1bExifMM"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"
URL_CHARS = "[A-Za-z0-9._~:/?#@!$&()*+,;=%\u2026-]"
URL_BOUNDARY = "(?:^|[^A-Za-z0-9_@])"
SHORT_LINKS = r"(?:bit\.ly|t\.co|goo\.gl)"
OPEN_DOMAINS = r"(?:(?:m\.)?youtube\.com|youtu\.be|tinyurl\.com|linktr\.ee|amzn\.to)"
LINK_TRAIL = ".,!?;:"
LOCAL_CHARS = "[A-Za-z0-9_+-]"
LABEL = "[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
SPACES = (
    " \t\n\r\f\v\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WORD = "[a-z]{3,}"
#: The same 25 characters within a class, in fewer steps.
SPACE_CLASS = " \t-\r\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

URL_SCHEME = f"https?://{URL_CHARS}+|{URL_BOUNDARY}www\\.{URL_CHARS}+"
URL_BARE = f"{SHORT_LINKS}/{URL_CHARS}+|{URL_BOUNDARY}{OPEN_DOMAINS}(?:/{URL_CHARS}*)?"
URL = f"{URL_SCHEME}|{URL_BARE}"
MENTION = f"@[^{SPACE_CLASS}@#]+"
HASHTAG = f"#[^{SPACE_CLASS}#@]+"
EMAIL_PORTABLE = rf"{LOCAL_CHARS}+(?:\.{LOCAL_CHARS}+)*@{LABEL}(?:\.{LABEL})+"
# End of the fixed values.

#: Every alternative of the clean pattern needs one of these in the folded text.
GATE = ("@", "#", "://", "www.", "bit.ly/", "t.co/", "goo.gl/", "youtube.com", "youtu.be", "tinyurl.com", "linktr.ee", "amzn.to")

_LABEL_JVM = "[A-Za-z0-9]++(?:-++[A-Za-z0-9]++)*+"
_RUN_START = rf"(?:\G|(?<!{LOCAL_CHARS})(?<!{LOCAL_CHARS}\.))"
EMAIL_JVM = rf"{_RUN_START}{LOCAL_CHARS}++(?:\.{LOCAL_CHARS}++)*+@{_LABEL_JVM}(?:\.{_LABEL_JVM})++"

CLEAN_PORTABLE = f"{URL}|{EMAIL_PORTABLE}|{MENTION}|{HASHTAG}"

# For the JVM the alternatives that need the boundary share one test of it, and mentions and hashtags, which run alike, are
# one. No text matches two of the alternatives that change places, so the leftmost match stays the same.
TAG_JVM = f"[@#][^{SPACE_CLASS}@#]+"
URL_JVM = (
    f"https?://{URL_CHARS}++|{URL_BOUNDARY}(?:www\\.{URL_CHARS}++|{OPEN_DOMAINS}(?:/{URL_CHARS}*+)?)|{SHORT_LINKS}/{URL_CHARS}++"
)
#: Every email has this in it.
MAIL_CORE = f"{LOCAL_CHARS}@[A-Za-z0-9]"
PAYLOAD_LINE = f"{PAYLOAD_MARKER}[^\n]*"
