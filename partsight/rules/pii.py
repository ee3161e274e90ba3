"""Fixed values of personal-data detection: types, priorities and patterns.

Patterns are written for Java regex without flags; ``functions.pii`` adds the Unicode and case flags.
"""

from __future__ import annotations

from partsight.rules.phrases import any_of

# Types in priority order (a tie in length goes to the earlier one).
TYPES = ("EMAIL", "SOCIAL", "URL", "CARD", "PHONE", "VIN", "PLATE")
TRAILING_PUNCTUATION = ".,;:!?)]}»\"'…"

# Words and characters.
SOCIAL_HOSTS = (
    "t.me", "telegram.me", "telegram.dog", "vk.com", "vk.ru", "vk.me", "vk.cc", "wa.me", "api.whatsapp.com",
    "chat.whatsapp.com", "whatsapp.com", "instagram.com", "ok.ru", "viber.click", "max.ru",
)
HANDLE_LENGTH = (3, 32)
# The platform's own name after "account" or "login" is no handle; replace it for another platform.
NOT_A_HANDLE = r"(?i)^avito\b"
# Words that a handle follows, as items of ``rules.phrases`` (``*`` any ending, ``_`` a blank or none).
HANDLE_LEMMAS = (
    "telegram tg тг whats_app viber vk вк вконтакте instagram insta discord skype login account username nick nickname "
    "телега телеги телегу телеге телегой телеграм* инста инсту инсте инсты инстой инстаграм* вайбер* дискорд* скайп* "
    "ватсап* вотсап* ватс_ап* вотс_ап* вацап* воцап* ватцап* вотцап* ватц_ап* вотц_ап* вас_ап* вос_ап* вац_ап* воц_ап* "
    "ник ника нике ником никнейм* логин* акк аккаунт* юзернейм*"
)
HANDLE_WORDS = any_of(HANDLE_LEMMAS)
# What each of the words begins with, for a cheap first look.
HANDLE_STEMS = "|".join(sorted({w.rstrip("*")[:3] if "_" in w or len(w) > 3 else w for w in HANDLE_LEMMAS.split()}))
LATIN_TLDS = (
    "ru|su|com|net|org|info|biz|pro|me|io|shop|store|online|site|kz|by|ua|uz|de|ly|cc|xyz|market"
    "|xn--[a-z0-9-]+"
)
CYRILLIC_TLDS = "рф|рус|москва"
VIN_LETTERS = "ABCDEFGHJKLMNPRSTUVWXYZАВЕКМНРСТХУ"
VIN_LENGTH, VIN_LAST_DIGITS = 17, 4
# A plate: L a letter, d a digit of the number, r of the region; parts may stand apart by a blank.
PLATE_FORM = "L ddd LL rr ?r"
PLATE_LONG_REGIONS = "1279"
PLATE_LETTERS = "АВЕКМНОРСТУХABEKMHOPCTYX"
PLATE_FOLD = ("АВЕКМНОРСТУХ", "ABEKMHOPCTYX")
O_LETTERS = "OoОо"

# Tokens that may hold an address, and what of a token is one. Every repetition is possessive, so a
# token of any length is found in one pass.
_TO_BLANK = r"[^\s<>\"'«»]"
MAIL_TOKEN = r"(?<![\w.+-])[\w.+-]++@[\w-]++(?:\.[\w-]++)++"
MAIL = r"^[^@]+@.+\.(?:\p{L}{2,}|xn--[a-z0-9-]+)(?![\w-])"
LINK_TOKEN = rf"(?<![\w.@])(?:https?://)?[a-z0-9-]++(?:\.[a-z0-9-]++)++/{_TO_BLANK}++"
HANDLE = r"(?<![\w@.])@[\w.]++(?!@)"
KEYWORD_HANDLE = rf"(?<!\w)((?:{HANDLE_WORDS})[ \t:@–—-]*)([A-Za-z][A-Za-z0-9_.]++)(?![\w@])"
URL_SCHEME = rf"(?<![\w@])(?:https?://|www\.){_TO_BLANK}++"
DOTTED = rf"(?<![\w@./-])[a-zа-яё0-9-]++(?:\.[a-zа-яё0-9-]++)++(?:/{_TO_BLANK}*+)?"
BARE_HOST = rf"^[^/]+\.(?:{LATIN_TLDS})(?![\w-])(?:/.*)?"
BARE_HOST_CYRILLIC = rf"^(?:[^/]*\.)?[^/.]{{2,}}\.(?:{CYRILLIC_TLDS})(?![\w-])(?:/.*)?"

# How digit groups of a number may stand apart, and how many digits it has.
CARD_GAP, CARD_DIGITS = " \t-", (13, 19)
GROUPED_CARD_GAP, CARD_GROUP, CARD_GROUPS = " \t-._", 4, 4
PHONE_GAP, PHONE_DIGITS, FOREIGN_DIGITS = " \t\r\n-.()/_", (10, 11), (10, 13)
