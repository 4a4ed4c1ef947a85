"""Fixed values of the extraction rules: word lists, scores, thresholds, patterns and host rules."""

# Score of a tag; others score 0.
TAG_SCORES = {
    "div": 5, "article": 5, "section": 5, "main": 5, "pre": 3, "blockquote": 3, "td": 3, "form": -3, "ol": -3, "ul": -3,
    "dl": -3, "dd": -3, "dt": -3, "li": -3, "address": -3, "h1": -5, "h2": -5, "h3": -5, "h4": -5, "h5": -5, "h6": -5, "th": -5,
}

# Parts of class and id that speak against content.
UNLIKELY = (
    "ad-break", "adbox", "advert", "addthis", "agegate", "aux", "banner", "breadcrumb", "combx", "comment", "community",
    "cookie", "disqus", "extra", "footer", "gdpr", "header", "hidden", "legends", "menu", "menubar", "meta", "mw-jump", "nav",
    "navigation", "newsletter", "outbrain", "pager", "pagination", "popup", "privacy", "promo", "rail", "related", "remark",
    "rss", "share", "shoutbox", "sidebar", "skyscraper", "social", "sponsor", "subscribe", "taboola", "teaser", "toolbar",
    "tweet", "twitter", "widget", "yom-remote",
)
# Parts that overrule the ones above.
MAYBE = ("and", "article", "body", "blogindex", "column", "content", "entry", "hentry", "main", "page", "posts", "shadow")
# Patterns that raise and lower the weight of class and id.
POSITIVE = (
    "article", "articlecontent", "blog", "body", "content", "entry", "hentry", "h-entry", "main", "page", "pagination", "post",
    "story", "text", r"[-_]copy", r"\Bcopy",
)
NEGATIVE = (
    "-ad-", "hidden", r"^hid$", r" hid$", r" hid ", r"^hid ", "banner", "combx", "comment", "com-", "contact", "disqus",
    "extra", "foot", "footer", "footnote", "gdpr", "header", "legends", "masthead", "media", "meta", "nav", "outbrain",
    "pager", "popup", "promo", "related", "remark", "rss", "share", "shoutbox", "sidebar", "skyscraper", "sponsor", "taboola",
    "teaser", "widget",
)
PHOTO = ("figure", "photo", "image", "caption")
ASSET = "entry-content-asset"
POSITIVE_WEIGHT, NEGATIVE_WEIGHT, PHOTO_WEIGHT, ASSET_WEIGHT = 25, -25, 10, 25

# Thresholds.
MIN_CANDIDATE_CHARS, MIN_PARAGRAPH_CHARS, LINK_DENSITY_LIMIT = 500, 25, 0.25
MIN_WORDS, MIN_WORDS_SERVED, EXCERPT_CHARS = 50, 150, 200

# Tags and roles that are removed with their content.
STRIP_TAGS = ("aside", "footer", "header", "nav", "noscript", "script", "style", "svg")
STRIP_ROLES = ("menu", "menubar", "complementary", "navigation", "alert", "alertdialog", "dialog")
# Tags that stay for a host.
KEPT_TAGS = {"infoworld.com": ("aside", "footer", "nav", "header"), "technologyreview.com": ("aside",)}
# Hosts whose boilerplate blocks stay, the selector to which the chosen node is moved, selectors removed.
KEEP_BOILERPLATE = ("martinfowler.com", "infoworld.com", "leaddev.com", "technologyreview.com")
MOVE_TO = {
    "thelocal.dk": ("#articleBody",), "themarginalian.org": (".entry_content",), "jsomers.net": (".entry-content", ".postContent"),
    "leaddev.com": (".article__body__col--main",), "technologyreview.com": ('[class*="columnArea--fullStory__wrapper"]',),
}
REMOVE = {
    "leaddev.com": (".gform_wrapper", ".gform_fields", ".ld-card", ".wp-block-pbc-card"),
    "infoworld.com": (
        ".primaryNav", ".header__container", ".header__menu", '[id^="header-menu-"]', ".article-hero", ".author-bio",
        "aside.social-share-sticky-menu", ".suggested-content-various", "script", ".ad", ".advert", ".ad-bottomleaderboard",
        ".rightTrailAd", "#newsletter-end", ".newsletter", "footer.footer",
    ),
    "technologyreview.com": ('[class*="fullStory__sidebar"]',),
}
CSS_ARTIFACT = r"\.?section-block\[data-block=\"hero-text-figure\"\].*?border-radius:\s*0 0 0 0;\s*}"

# Images.
TRACKING_FILES = ("pixel.gif", "pixel.png", "1x1.gif", "1x1.png", "spacer.gif", "spacer.png", "blank.gif", "blank.png")
TRACKING_DOMAINS = ("tracking.", "analytics.", "metrics.")
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "gif", "webp", "svg", "bmp", "avif", "apng", "tiff", "jfif")
DATA_IMAGES = ("png", "jpeg", "jpg", "gif", "webp", "avif", "bmp")

# Signs of boilerplate blocks.
BOILERPLATE_PHRASES = (
    "privacy policy", "cookie policy", "terms of use", "terms and conditions", "more from", "more recent articles",
    "related posts", "join the conversation", "add a comment", "see also", "free newsletter", "share this",
)
BOILERPLATE_HINTS = (
    "comment", "newsletter", "subscribe", "share", "social", "recent", "metabox", "worth", "promo", "advert", "ad-",
    "entryfooter", "pagenav", "article-single__tags", "articlebodyforbidden", "author-bio", "deepdive", "sso", "login",
    "signin", "register", "full-reg-form",
)
STRONG_HINTS = (
    "comment", "newsletter", "subscribe", "ad-container", "advert", "entryfooter", "pagenav", "deepdive", "sso",
    "full-reg-form", "register", "login",
)
BOILERPLATE_TAGS = ("div", "section", "aside", "ul", "ol", "p")

# Statuses of pages that are gone, and what an article sent with one looks like.
GONE = (404, 410)
EXTRACTABLE_CHARS, EXTRACTABLE_SIGNS = 500, ("<article", "<main", "</p>")

# Attributes that hold URLs.
URL_ATTRIBUTES = {
    "a": ("href",), "img": ("src", "srcset"), "source": ("src", "srcset"), "video": ("src", "poster"), "audio": ("src",),
    "track": ("src",), "link": ("href",), "iframe": ("src",), "embed": ("src",), "object": ("data",),
}

# Path endings that are not pages.
NOT_PAGES = (
    "css", "js", "json", "xml", "txt", "pdf", "zip", "tar", "gz", "png", "jpg", "jpeg", "gif", "svg", "ico", "webp", "bmp",
    "mp3", "mp4", "avi", "mov", "wav", "flv", "wmv", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "woff", "woff2", "ttf",
    "eot", "otf",
)


def either(parts: tuple[str, ...]) -> str:
    """A pattern that matches any of the parts."""
    return "|".join(parts)
