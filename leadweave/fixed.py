"""Patterns, word lists, titles and message texts.

Results must equal these exactly, so they are kept together as plain data.
"""

# --- fixed values: contact patterns -----------------------------------------
# The last repeat of EMAIL is possessive: nothing follows it, so the matches are
# the same, and Java then loops instead of recursing on very long host names.
EMAIL = r"(?i)(?:^|[^a-z0-9._%+\-])([a-z0-9][a-z0-9._%+\-]*@[a-z0-9](?:[a-z0-9\-]*[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9\-]*[a-z0-9])?)++)"
TELEGRAM = r"(?i)(?:https?://)?(?:www\.)?(?:t\.me|telegram\.me)/([a-z0-9_]{5,32})|(?:^|[^a-z0-9._%+\-])@([a-z0-9_]{5,32})"
LINKEDIN = r"(?i)(?:https?://)?(?:www\.)?linkedin\.com/(?:in|company|pub)/[a-z0-9_%-]+"
TWITTER = r"(?i)(?:https?://)?(?:www\.)?(?:twitter\.com|x\.com)/([a-z0-9_]{1,15})"
SKYPE = r"(?i)(?:skype:|live:)[a-z0-9_.-]+"
DISCORD_INVITE = r"(?i)(?:https?://)?(?:www\.)?(?:discord\.gg|discord\.com/invite)/[a-z0-9-]+"
DISCORD_TAG = r"(?i)(?:^|[^a-z0-9])([a-z0-9_.-]{2,32}#[0-9]{4})"

# --- fixed values: words dropped by the extractors ---------------------------
ASSET_SUFFIXES = (".png", ".jpg", ".jpeg", ".gif", ".svg", ".webp", ".css", ".js", ".ico")
TELEGRAM_SYSTEM = ("share", "joinchat", "addstickers", "context")
TWITTER_SYSTEM = ("intent", "share", "home", "search")
NOISE_TERMS = ("affpaying", "affiliatepaying")

# --- fixed values: link cleaning ---------------------------------------------
CARD_PATH_BLACKLIST = (
    "affiliate-networks", "affiliate-programs", "categories", "category", "login",
    "signup", "register", "contact", "about", "search", "page",
)
PROFILE_SEGMENT = "network"

# --- fixed values: page layout by host ---------------------------------------
DEFAULT_ROUTES = (
    ("affpaying.com", "A"), ("www.affpaying.com", "A"),
    ("offervault.com", "B"), ("www.offervault.com", "B"),
)

# --- fixed values: manager blocks --------------------------------------------
MANAGER_PHRASES_A = ("affiliate manager", "account manager")
MANAGER_PHRASES_B = ("affiliate manager", "account manager", "network contact")
MANAGER_ATTRIBUTES_A = ("data-email", "data-tippy", "title", "href")
MANAGER_ATTRIBUTES_B = ("data-email", "data-tippy", "title", "href", "content")

# --- fixed values: lead rules -------------------------------------------------
MAIL_TLDS = (".ru", ".by", ".kz", ".su", ".ua", ".rf")
MAIL_PROVIDERS = ("yandex.", "mail.ru", "bk.ru", "inbox.ru", "list.ru", "rambler.ru", "ukr.net", "gmx.ru")
SYSTEM_LOCAL_PARTS = ("admin", "info", "support", "contact", "sales", "help", "billing")
NAME_TOKENS = (
    "aleks", "alexander", "alexey", "dmitry", "dmitrii", "sergey", "sergei", "ivan", "vladimir",
    "anna", "ekaterina", "elena", "olga", "natasha", "mikhail", "artem", "pavel", "igor", "yury", "evgeny",
    "viktoriia", "victoria", "vlad", "bogdan", "danylo", "daria",
)
NAME_SUFFIX = r"(?i)(?:[a-z]{3,})(?:enko|chuk|vych|wich|ov|ova|ev|eva|in|ina|skaya|skiy|sky|sks)\z"
IGNORED_WORDS = ("justin", "main", "fin", "bin", "win", "domain")

# --- fixed values: verdicts ---------------------------------------------------
USABLE_STATUSES = ("VALID", "SKIPPED")
NOT_OCCUPIED_TEXT = "username is not occupied; deletion cannot be confirmed by username"
DELETED_TEXT = "Telegram account is marked as deleted"
EMPTY_HANDLE_TEXT = "empty username"
NO_LOOKUP_TEXT = "Telegram validation is disabled"

# --- fixed values: flat export ------------------------------------------------
EXPORT_TITLES = (
    "ID", "Company Name", "Source URL", "Emails", "Telegram Handles", "TG Validation Status",
    "LinkedIn", "Skype", "Discord", "Twitter", "Is CIS", "CIS Reason", "Created At",
)

# --- fixed values: white space as Unicode defines it --------------------------
SPACE_CLASS = r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
SPACE_CHARS = "".join(map(chr, (
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)))
