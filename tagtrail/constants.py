"""Fixed values that must stay equal to the reference behaviour.

FIXED VALUES: the patterns, templates and defaults below are reproduced as
plain text, in their natural order, because results depend on them exactly.
"""

# ---------------------------------------------------------------- fixed values
# Page families whose paths are not item pages (matched at the start of the
# URL path, as Python's re.match does).
PAGE_FAMILIES: dict[str, str] = {
    "member": r"/+member\.(?:php|html)",
    "newslist": r"/+newslist\.(?:php|html)",
    "specialty": r"/+specialty\.(?:php|html)",
    "authenticate": r"/+authenticate\.(?:php|html)",
    "contact": r"/+contact(_proposal)?\.(?:php|html)",
    "forget": r"/+forget\.(?:php|html)",
    "inquiry": r"/+inquiry\.(?:php|html)",
    "sentok": r"/+sentok\.(?:php|html)",
    "brand": r"/+brand\.(?:php|html)",
    "precursor": r"/+precursor\.(?:php|html)",
    "new_ecpay_payment": r"/+new_ecpay_payment(_3d)?\.php",
    "shopping_cart": r"/+shoppingcart\.(?:html|php)",
    "home": r"/+((?:index|inpage|favorable|cheap)\.(?:html|php))?$",
    "insearch": r"/+insearch\.html",
    "modify": r"/+modify\.html",
    "order": r"/+(?:mob|new_|newmob)?order(?:ok|_\d+)?\.html",
    "orderview": r"/+(?:orderview|oview)(_[\w\d_]+)?\.html",
    "login": r"/+login(_\d+)?\.(?:php|html)",
    "register": r"/+register(?:ed|start)?\.(?:php|html)",
    "getbouns": r"/+(?:get|set)?bonus(_\S+)?\.html",
    "getgift": r"/+getgift_\S+?\.html",
    "fag": r"/+faq(_\d+)?\.(?:html|php)",
    "bulletin": r"/+bulletin_(\d+)\.html",
    "cheapview": r"/+cheapview_(\d+)\.(?:php|html)",
    "bastchoice": r"/+bastchoice\.(?:php|html)",
    "inpage": r"/+(?:inpage|index)_(\d+)(_(\d+))?\.html",
}

# Item pages.
ITEM_CHEAP = r"/+cheap_(\d+)\.html"
ITEM_FAVORABLE = r"/+favorable_(\d+)\.html"
ITEM_PATH = r"/+(?:cheap|favorable)_(\d+)\.html"
# Product id anywhere in a URL (unanchored search).
URL_PID = r"(?:favorable|cheap)_(\d+)"
# Category of the listing page a load was referred from.
REFERRER_CATEGORY = r"/+(?:inpage|index)_(\d+)(_(\d+))?\.html"

# Tag / word extraction from generated text.
TAG_PATTERN = r"\b[a-zA-Z- ]+\b"
WORD_PATTERN = r"[a-zA-Z-]{2,}"

# Markers removed from generated text (case-insensitive).
GENERATION_MARKERS = [
    r"\[[\\/]?inst\]",
    r"<[\\/]?s>",
    r"assistant:?",
    r"<[\\/]?\w+>",
]
INST_CLOSE = "[/INST]"

# Chat prompt layouts.
PROMPT_LEGACY = "[INST] <<SYS>>\n{instruction}\n<</SYS>>\n\n{user_instruction}\n{input}\n[/INST]\n"
PROMPT = "[INST] <<SYS>>\n{instruction}\n<</SYS>>\n{user_instruction}\n[/INST]\n{input}\n"

# Defaults of the evaluation and data preparation.
TRAIN_RATIO = 0.7
VAL_RATIO = 0.2
DEFAULT_KS = (5, 10, 20)
BM25_K1 = 1.5
BM25_B = 0.75
BM25_ALPHA = 4.0
EVALUATOR_BM25_K1 = 0.75
CUTOFF_LEN = 512
LABEL_IGNORE = -100
FIRST_TIME_BUYER = "First time buyer"
# ------------------------------------------------------------ end fixed values

# Domain pattern of the shop in the driver fixtures (the reference's own
# shop domain is a parameter value, not a constant of the engine).
FIXTURE_DOMAIN = r"(mob\.)?shop.example"
