"""Patterns, word lists, lookup tables and limits.

Everything in this module is data that decides the results (shapes of
identifiers, keyword lists, registry tables). It is kept as plain text in its
natural order. Patterns are written in ECMAScript regex syntax and translated
for the JVM by ``maskwright.functions.rx``.
"""

from __future__ import annotations

from dataclasses import dataclass

# --------------------------------------------------------------------------
# shapes
# --------------------------------------------------------------------------

EMAIL = r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"

# Generic numbers, seven alternatives, the first one that fits at a position wins.
NUMERIC_ALTERNATIVES = (
    ("money_symbol", r"[$€£¥₹₩₿₺₨₱฿]\s*\d(?:[\d,.' ]*\d)?"),
    ("money_code", r"\b\d[\d,.' ]*\s*(?:USD|EUR|GBP|JPY|INR|BTC|ETH)\b"),
    ("thousands", r"\b\d{1,3}(?:,\d{3})+(?:\.\d{1,2})?\b"),
    (
        "phone_parens",
        r"\+?(?:\d{1,3}[ \-\u00A0])?\(\d{1,4}\)[ \-\u00A0]?\s*\d{2,}(?:[ \-\u00A0]\d{2,})*",
    ),
    ("phone_groups", r"\+?\d{1,3}(?:[ \-\u00A0]\d{2,}){2,}"),
    ("digit_groups", r"\b\d{3,}(?:[ \-\u00A0]\d{3,})+\b"),
    ("bare_digits", r"\b\d{4,}\b"),
)
NUMERIC = "|".join(p for _, p in NUMERIC_ALTERNATIVES)


@dataclass(frozen=True)
class Detector:
    """One row of the detector catalogue.

    ``gate`` holds alternatives a text must contain for the shape to be tried:
    plain strings in ``contains`` or one pattern in ``gate``. ``action`` is
    ``emit`` (report) or ``claim`` (take the range, report nothing). Every match
    holds one of ``outline``, where 0 stands for a digit and A for a capital.
    """

    id: str
    pattern: str
    stage: int
    validator: str | None = None
    countries: tuple[str, ...] = ()
    keyword: str | None = None
    window: int = 50
    action: str = "emit"
    gate: str | None = None
    contains: tuple[str, ...] = ()
    dispositive: bool = False
    outline: tuple[str, ...] = ()


# Stage 1: the shape, or the shape and a checksum, is enough.
STAGE1 = (
    Detector("card_pan", r"(?<![A-Za-z\d])(?:\d[ \-]?){11,18}\d(?![A-Za-z\d])", 1,
             validator="card_pan", gate=r"\d{4}", dispositive=True),
    Detector("iban", r"(?<![A-Za-z\d])[A-Z]{2}\d{2}[A-Z0-9 \-]{11,42}(?![A-Za-z\d])", 1,
             validator="iban", gate=r"[A-Z]{2}\d{2}", dispositive=True,
             outline=("AA00",)),
    Detector("eth_wallet", r"\b0x[a-fA-F0-9]{40}\b", 1, contains=("0x",), dispositive=True),
    Detector("isbn_13", r"\b97[89][\- ]?\d[\- ]?\d{3}[\- ]?\d{5}[\- ]?\d\b", 1,
             validator="isbn_13", contains=("978", "979"), action="claim", dispositive=True),
    Detector("e164_phone", r"\+\d{1,3}[ .\-\u00A0]?\d[\d .\-\u00A0]{6,14}\d\b", 1,
             contains=("+",), dispositive=True,
             outline=("+0",)),
    Detector("aadhaar", r"\b[2-9]\d{3}[ \-]?\d{4}[ \-]?\d{4}\b", 1,
             validator="aadhaar", gate=r"\d{4}", dispositive=True,
             outline=("00000000", "0000 0000", "0000-0000")),
    Detector("cn_id", r"\b\d{17}[\dXx]\b", 1, validator="cn_id", gate=r"\d{17}", dispositive=True),
    Detector("nric_sg", r"\b[STFGM]\d{7}[A-Z]\b", 1, gate=r"[STFGM]\d", dispositive=True,
             outline=("A0000000A",)),
    Detector("curp_mx", r"\b[A-Z]{4}\d{6}[HM][A-Z]{2}[A-Z]{3}[A-Z0-9]\d\b", 1,
             gate=r"[A-Z]{4}\d{6}", dispositive=True,
             outline=("AAAA000000A",)),
    Detector("emirates_id", r"\b784[ \-]?\d{4}[ \-]?\d{7}[ \-]?\d\b", 1,
             contains=("784",), dispositive=True),
    Detector("nie_es", r"\b[XYZ]\d{7}[A-HJ-NP-TV-Z]\b", 1, gate=r"[XYZ]\d", dispositive=True,
             outline=("A0000000A",)),
    Detector("codice_fiscale", r"\b[A-Z]{6}\d{2}[A-Z]\d{2}[A-Z]\d{3}[A-Z]\b", 1,
             gate=r"[A-Z]{6}\d{2}", dispositive=True,
             outline=("AAAAAA00A00A000A",)),
    Detector("postal_uk", r"\b[A-Z]{1,2}\d[A-Z\d]?[ ]?\d[A-Z]{2}\b", 1,
             gate=r"[A-Z]\d", dispositive=True,
             outline=("0AA",)),
    Detector("postal_ca",
             r"\b[ABCEGHJ-NPR-TV-Z]\d[ABCEGHJ-NPR-TV-Z][ \-]?\d[ABCEGHJ-NPR-TV-Z]\d\b", 1,
             gate=r"[A-Z]\d[A-Z]", dispositive=True,
             outline=("A0A0A0", "A0A 0A0", "A0A-0A0")),
    Detector("ipv6",
             r"\b(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}\b"
             r"|\b(?:[0-9A-Fa-f]{1,4}:){1,7}:"
             r"|\b(?:[0-9A-Fa-f]{1,4}:){1,6}:[0-9A-Fa-f]{1,4}\b", 1,
             contains=(":",), dispositive=True),
    Detector("gps_dms", r"\b\d{1,3}°\d{1,2}['′]\d{1,2}(?:\.\d+)?[\"″]\s?[NSEW]\b", 1,
             contains=("°",), dispositive=True),
    Detector("plus_code", r"\b[2-9CFGHJMPQRVWX]{4,8}\+[2-9CFGHJMPQRVWX]{2,3}\b", 1,
             contains=("+",), dispositive=True),
)

# Stage 2: the shape needs a page country or a keyword close by.
STAGE2 = (
    Detector("mac_address", r"\b(?:[0-9A-Fa-f]{2}[:\-]){5}[0-9A-Fa-f]{2}\b", 2,
             contains=(":", "-"), dispositive=True),
    Detector("ipv4",
             r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b", 2,
             validator="ipv4", gate=r"\d\.\d",
             keyword=r"\b(?:ip|ipv4|address|server|host|client|connect(?:ed|ion|ing|s)?|from)\b"),
    Detector("imei", r"\b\d{15}\b", 2, validator="imei", gate=r"\d{15}",
             keyword=r"\b(?:imei|device(?:\s+id)?)\b"),
    Detector("ssn_us", r"\b(?!000|666|9\d{2})\d{3}-(?!00)\d{2}-(?!0000)\d{4}\b", 2,
             countries=("US",), gate=r"\d{3}-\d{2}-\d{4}",
             keyword=r"\b(?:ssn|social\s+security|social\s+sec)\b"),
    Detector("nhs_uk", r"\b\d{3}[ \-]?\d{3}[ \-]?\d{4}\b", 2, validator="nhs_uk",
             countries=("GB",), gate=r"\d{3}",
             keyword=r"\b(?:nhs|national\s+health|patient)\b",
             outline=("000000", "000 000", "000-000")),
    Detector("bsn_nl", r"\b\d{9}\b", 2, validator="bsn_nl", countries=("NL",), gate=r"\d{9}",
             keyword=r"\b(?:bsn|burgerservicenummer|sofinummer)\b",
             outline=("000000000",)),
    Detector("npi_us", r"\b\d{10}\b", 2, validator="npi_us", gate=r"\d{10}",
             keyword=r"\b(?:npi|provider(?:\s+id)?|national\s+provider)\b",
             outline=("0000000000",)),
    Detector("dni_es", r"\b\d{8}[A-HJ-NP-TV-Z]\b", 2, countries=("ES",), gate=r"\d{8}[A-Z]",
             keyword=r"\b(?:dni|d\.n\.i\.|documento\s+nacional)\b",
             outline=("00000000A",)),
    Detector("abn_au", r"\b\d{2} ?\d{3} ?\d{3} ?\d{3}\b", 2, countries=("AU",),
             gate=r"\d{2} ?\d{3}", keyword=r"\b(?:abn|australian\s+business\s+number)\b",
             outline=("000000", "000 000")),
    Detector("mrn", r"\b\d{4,10}\b", 2, gate=r"\d{4}",
             keyword=r"\b(?:mrn|medical\s+record(?:\s+number)?|chart(?:\s+(?:no|number))?"
                     r"|patient(?:\s+(?:id|no|number))?)\b"),
    Detector("postal_jp", r"(?:〒\s?)?\b\d{3}-\d{4}\b", 2, countries=("JP",), window=30,
             gate=r"\d{3}-\d{4}|〒", keyword=r"〒|postal\s+code|郵便番号",
             outline=("000-0000",)),
    Detector("postal_au", r"\b\d{4}\b", 2, countries=("AU",), window=30, gate=r"\d{4}",
             keyword=r"\b(?:postal|postcode|po\s+box|po\.?\s+box)\b"),
    Detector("postal_nl", r"\b[1-9]\d{3} ?[A-Z]{2}\b", 2, countries=("NL",), window=30,
             gate=r"\d{4}", keyword=r"\b(?:postcode|postbus)\b",
             outline=("0000AA", "0000 AA")),
    Detector("postal_br", r"\b\d{5}-\d{3}\b", 2, countries=("BR",), window=30,
             gate=r"\d{5}-\d{3}", keyword=r"\b(?:cep|c\.e\.p\.)\b"),
    Detector("us_zip4", r"\b\d{5}-\d{4}\b", 2, countries=("US",), window=30,
             gate=r"\d{5}-\d{4}", keyword=r"\b(?:zip|zipcode|zip\s+code|postal\s+code)\b"),
    Detector("eircode_ie", r"\b[AC-FHKNPRTV-Y][0-9W][0-9 ][AC-FHKNPRTV-Y0-9]{4}\b", 2,
             countries=("IE",), window=30, gate=r"[A-Z]\d",
             keyword=r"\b(?:eircode|eir\s+code)\b"),
)

# Identifier pass: tokens with a provider prefix.
SECRET_TOKEN = (
    r"\b(?:"
    r"(?:Bearer|Basic)\s+[A-Za-z0-9._\-+/=]{20,}"
    r"|github_pat_[A-Za-z0-9_]{82}"
    r"|dckr_pat_[A-Za-z0-9_\-]{20,}"
    r"|dop_v1_[a-f0-9]{64}"
    r"|sk-ant-[A-Za-z0-9_\-]{90,}"
    r"|[sp]k_(?:live|test)_[A-Za-z0-9]{24,}"
    r"|glpat-[A-Za-z0-9_\-]{20,}"
    r"|pypi-[A-Za-z0-9_\-]{100,}"
    r"|AKIA[0-9A-Z]{16}"
    r"|AIza[A-Za-z0-9_\-]{35}"
    r"|xox[bpoars]-[A-Za-z0-9\-]{10,}"
    r"|eyJ[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}"
    r"|SG\.[A-Za-z0-9_\-]{22}\.[A-Za-z0-9_\-]{43}"
    r"|npm_[A-Za-z0-9]{36}"
    r"|ghp_[A-Za-z0-9]{36}"
    r"|sk-[A-Za-z0-9]{20,}"
    r"|AC[a-f0-9]{32}"
    r"|hf_[A-Za-z0-9]{34}"
    r")\b"
)

# A text without any of these holds no such token; by a character they all hold.
SECRET_TOKEN_PARTS = {
    "_": ("github_pat_", "dckr_pat_", "dop_v1_", "k_live_", "k_test_", "npm_", "ghp_", "hf_"),
    "-": ("sk-", "glpat-", "pypi-", "xox"),
    "": ("Bearer", "Basic", "AKIA", "AIza", "eyJ", "SG.", "AC"),
}

# Identifier pass: words that announce an identifier value.
KEYWORDS = (
    "user[ _-]?id", "account[ _-]?id", "customer[ _-]?id", "employee[ _-]?id",
    "member[ _-]?id", "patient[ _-]?id", "tenant[ _-]?id", "org[ _-]?id",
    "device[ _-]?id", "session[ _-]?id", "request[ _-]?id", "trace[ _-]?id",
    "correlation[ _-]?id", "transaction[ _-]?id", "txn[ _-]?id", "client[ _-]?id",
    "client[ _-]?secret", "api[ _-]?key", "api[ _-]?secret", "access[ _-]?key",
    "access[ _-]?token", "refresh[ _-]?token", "private[ _-]?key", "public[ _-]?key",
    "verification[ _-]?code", "security[ _-]?code",
    "confirmation[ _-]?(?:code|no|number|id)", "serial[ _-]?(?:no|number)",
    "license[ _-]?(?:key|no|number)", "policy[ _-]?(?:no|number)",
    r"ref[ _.\-]?(?:no|num)",
    "authentication", "authorization", "verification", "confirmation", "credentials",
    "identifier", "membership", "reference", "passcode", "username", "password",
    "employee", "customer", "security", "license", "licence", "account", "session",
    "request", "private", "tracking", "invoice", "serial", "policy", "access",
    "secret", "bearer", "client", "member", "ticket", "token", "order", "auth",
    "cred", "pass", "user", "case", "uid", "emp", "acct", "num", "no", "key", "ref",
    "pwd", "pin", "otp", "database", "connection", "webhook", "endpoint", "dsn",
    "mongo", "redis", "postgres", "mysql", "smtp", "imap", "id",
)
# Longest spelling first, so that "user id" is preferred over "user".
KEYWORDS_LONGEST_FIRST = tuple(sorted(KEYWORDS, key=len, reverse=True))
KEYWORD_ALT = "(?:" + "|".join(KEYWORDS_LONGEST_FIRST) + ")"
KEYWORD_VALUE_TAIL = (
    r"\b\s*[:=#\-—]?\s*(?:is\s+|of\s+)?[\"']?"
    r"([A-Za-z0-9][A-Za-z0-9._\-]{11,63})[\"']?"
)
KEYWORD_VALUE = r"\b" + KEYWORD_ALT + KEYWORD_VALUE_TAIL
KEYWORD_TRAIL = KEYWORD_ALT + r"\s*[:=#\-—]?\s*$"
SHORT_DIGIT_NODE = r"^\s*\d[\d \-]{2,14}\d\s*$"
PRECEDING_LIMIT = 120

# --------------------------------------------------------------------------
# False-positive rules for generic numbers
# --------------------------------------------------------------------------

PUBLIC_PRICE = (
    r"/mo(?:nth)?|/y(?:r|ear)|per month|per year|\bcart\b|\bqty\b|\bquantity\b|\bunits\b"
    r"|\brating\b|\breviews?\b|\bstars?\b|\bprice\b|\bcost\b|\btotal\b|\bsubtotal\b|\bsale\b"
    r"|\bdiscount\b|\bMRP\b|precio|carrito|cantidad|valoración|valoraci[oó]n|estrellas|prix"
    r"|panier|quantité|évaluation|étoiles|Preis|Warenkorb|Menge|Bewertung|Sterne|prezzo"
    r"|carrello|quantità|valutazione|stelle|価格|カート|数量|評価|星|价格|购物车|数量|评分"
    r"|कीमत|दाम|मूल्य|कार्ट|मात्रा|रेटिंग"
)
COUNT_NOISE = (
    r"unread|notifications?|messages?|followers?|following|likes?|views?|comments?|results?"
    r"|items?|members?|subscribers?|posts?|connections?|shares?|replies|replies?|reactions?"
    r"|upvotes?|downvotes?|stock|available|inventory|page|of|showing|seguidores|comentarios"
    r"|me gusta|vistas|disponibles|resultados|página|abonnés|commentaires|mentions j'aime|vues"
    r"|disponibles|résultats|page|Follower|Kommentare|Likes|Aufrufe|verfügbar|Ergebnisse|Seite"
    r"|フォロワー|コメント|いいね|視聴回数|在庫|件|ページ|粉丝|评论|点赞|浏览|库存|结果|页"
    r"|फॉलोअर|टिप्पणियां|लाइक|दृश्य|स्टॉक|परिणाम|पृष्ठ"
)
UNIT_TRAIL = (
    r"^[ \u00A0]?(?:[KMGTPE]i?B|[KkMmGg]?bps|[MGmg]?Hz|fps|°[CFK]|°|km|cm|mm|nm|mi|ft|in|yd|kg"
    r"|lb|oz|mg|tons?|sec|min|hr|hours?|days?|weeks?|months?|years?|mL|gal|kWh|mAh|Pa|bar|sqft"
    r"|m²|m\^2)\b"
)
RESOLUTION = r"\d+\s?[x×:]\s?\d+"
ORDINAL_PRECURSOR = (
    r"(?:section|chapter|page|article|step|item|question|lecture|exercise|lesson|number|no\.?"
    r"|row|line|entry|paragraph|verse|figure|table|appendix|sección|capítulo|página|paso"
    r"|pregunta|chapitre|étape|Abschnitt|Kapitel|Seite|Schritt|Frage|Nummer|Nr\.?|章|節|ページ"
    r"|ステップ|問|页|步骤|题|अध्याय|पृष्ठ|चरण|प्रश्न)[\s.:#]+$"
)
DATE_SHAPES = (
    r"^\d{4}-\d{2}-\d{2}$",
    r"^\d{4}/\d{2}/\d{2}$",
    r"^\d{2}/\d{2}/\d{4}$",
    r"^\d{2}\.\d{2}\.\d{4}$",
    r"^\d{4}\.\d{2}\.\d{2}$",
    r"^\d{4}-W\d{2}(?:-\d)?$",
    r"^\d{4}-\d{3}$",
)
DATE_KEYWORD = (
    r"\b(?:date|posted|published|updated|created|modified|due|expires|expir(?:es|ation|y|ed)"
    r"|valid(?: until)?|as of|since|fecha|publicado|actualizado|vence|date|publié|mis à jour"
    r"|expire|Datum|veröffentlicht|aktualisiert|gültig|fällig|日付|投稿|更新|期限|更新|日期|发布"
    r"|更新|截止|तारीख|दिनांक|प्रकाशित)\b"
)
DATE_SHAPE_FOR_KEYWORD = r"^(?:\d{1,4}|\d{1,4}[ /.\-]\d{1,4}(?:[ /.\-]\d{1,4})?)$"
ORDER_REF = (
    r"\b(?:order|tracking|invoice|case|ticket|reference|confirmation|booking|receipt|sku|model"
    r"|isbn|issn|episode|pedido|factura|recibo|seguimiento|caso|commande|facture|reçu|suivi"
    r"|dossier|Bestellung|Rechnung|Quittung|Sendungsverfolgung|Fall|注文|請求書|領収書|追跡"
    r"|チケット|订单|发票|收据|跟踪|工单|आदेश|बीजक|रसीद)\b"
)
STATISTIC = (
    r"\b(?:p\s*[<=>]|n\s*=|sample\s+size|cohort|CI|confidence\s+interval|95%|99%|SD|SE|σ|R²"
    r"|R\^2|r\s*=)\b"
)

# --------------------------------------------------------------------------
# Registry tables
# --------------------------------------------------------------------------

# IBAN length by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28,
    "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28,
    "CH": 21, "CR": 22, "CY": 28, "CZ": 24,
    "DE": 22, "DK": 18, "DO": 28,
    "EE": 20, "EG": 29, "ES": 24,
    "FI": 18, "FO": 18, "FR": 27,
    "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28,
    "HR": 21, "HU": 28,
    "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27,
    "JO": 30,
    "KW": 30, "KZ": 20,
    "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25,
    "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30,
    "NL": 18, "NO": 15,
    "PK": 24, "PL": 28, "PS": 29, "PT": 25,
    "QA": 29,
    "RO": 24, "RS": 22,
    "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28,
    "TL": 23, "TN": 24, "TR": 26,
    "UA": 29,
    "VA": 22, "VG": 24,
    "XK": 20,
}

# Country by last host label.
TLD_COUNTRY = {
    "uk": "GB", "gb": "GB", "us": "US", "in": "IN", "de": "DE", "fr": "FR", "jp": "JP",
    "cn": "CN", "kr": "KR", "au": "AU", "ca": "CA", "br": "BR", "mx": "MX", "ru": "RU",
    "es": "ES", "it": "IT", "nl": "NL", "se": "SE", "ch": "CH", "at": "AT", "be": "BE",
    "pl": "PL", "sg": "SG", "ae": "AE", "sa": "SA", "za": "ZA", "tr": "TR", "no": "NO",
    "dk": "DK", "fi": "FI", "ie": "IE", "nz": "NZ", "ar": "AR", "cl": "CL", "pe": "PE",
    "hk": "HK", "tw": "TW", "th": "TH", "vn": "VN", "ph": "PH", "my": "MY", "il": "IL",
    "eg": "EG", "id": "ID",
}

# Country by currency sign, single-country signs only, in tie-break order.
CURRENCY_COUNTRY = (("£", "GB"), ("₹", "IN"), ("₩", "KR"), ("₽", "RU"))
CURRENCY_SAMPLE = 1000
LANG_REGION = r"^[a-z]{2,3}(?:[-_][A-Za-z]{4})?[-_]([A-Za-z]{2})\b"

NHS_WEIGHTS = (10, 9, 8, 7, 6, 5, 4, 3, 2)
BSN_WEIGHTS = (9, 8, 7, 6, 5, 4, 3, 2)
CN_ID_WEIGHTS = (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2)
VERHOEFF_PERMUTATION = (1, 5, 7, 6, 2, 8, 3, 0, 9, 4)

# --------------------------------------------------------------------------
# pages
# --------------------------------------------------------------------------

SKIP_TAGS = ("code", "kbd", "samp", "script", "style", "noscript")
EDITOR_CLASSES = ("codehilite", "cm-editor", "CodeMirror", "monaco-editor", "ace_editor")
VOID_TAGS = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta",
             "param", "source", "track", "wbr")
RAW_TEXT_TAGS = ("script", "style", "noscript", "textarea", "title")
BLOCK_TAGS = (
    "p", "div", "li", "td", "th", "tr", "section", "article", "header", "footer", "nav",
    "aside", "main", "blockquote", "dd", "dt", "figcaption", "figure", "h1", "h2", "h3",
    "h4", "h5", "h6", "hr", "ol", "ul", "dl", "pre", "table", "tbody", "thead", "tfoot",
    "details", "summary", "form", "fieldset",
)
RESTRICTED_SCHEMES = ("chrome", "chrome-extension", "edge", "about", "moz-extension",
                      "view-source", "devtools", "chrome-search")
STORE_HOST = "chromewebstore.google.com"
STORE_PATH_HOST = "chrome.google.com"
STORE_PATH = "/webstore"
REPLACEMENT_TITLE = "Tab"
BLANK_ICON = "data:image/png;base64,iVBORw0KGgoAAAANSUhEUgAAAAEAAAABCAYAAAAfFcSJAAAAC0lEQVQI12NgAAIABQABNjN9GQAAAAlwSFlzAAAWJQAAFiUBSVIk8AAAAA0lEQVQI12P4z8BQDwAEgAF/QualIQAAAABJRU5ErkJggg=="

CATEGORY_ORDER = ("text", "media", "structure", "form", "table")
CATEGORY_TAGS = {
    "text": {
        "always": ("h1", "h2", "h3", "h4", "h5", "h6", "hgroup", "p", "blockquote", "pre",
                   "figcaption", "summary"),
        "check": ("span", "a", "label", "em", "strong", "b", "i", "u", "cite", "q", "mark",
                  "abbr", "time", "address", "small", "code", "kbd", "samp", "var", "dfn",
                  "data", "del", "ins", "s", "sub", "sup", "bdo", "bdi", "ruby", "rt", "rp"),
        "role": (),
    },
    "media": {
        "always": ("img", "video", "audio", "canvas", "svg"),
        "check": (),
        "role": (),
    },
    "form": {
        "always": ("input", "textarea", "select", "progress", "meter"),
        "check": ("button", "output", "fieldset", "legend"),
        "role": ("button", "checkbox", "radio", "switch", "textbox", "searchbox", "combobox",
                 "listbox", "spinbutton", "slider", "menuitem", "menuitemcheckbox",
                 "menuitemradio", "option", "tab"),
    },
    "table": {"always": ("caption",), "check": ("td", "th"), "role": ()},
    "structure": {
        "always": ("li", "dt", "dd"),
        "check": ("div", "section", "article", "aside", "header", "footer", "figure",
                  "details", "dialog"),
        "role": (),
    },
}
DEFAULT_CATEGORIES = ("text", "media", "structure", "table")
STABLE_ATTRIBUTES = ("data-testid", "data-cy", "data-id", "data-name", "data-key",
                     "data-component", "name")
ARIA_LABEL_LIMIT = 80

# --------------------------------------------------------------------------
# Settings model
# --------------------------------------------------------------------------

REVEAL_MODES = ("none", "click", "hover")
BLUR_MODES = ("blur", "frosted", "redacted", "censored")
PICKER_MODES = ("dynamic", "sticky-page", "sticky-screen")
PICK_BLUR_MODES = ("blur", "frosted", "color")
PII_MODES = ("blur", "frosted", "redacted", "starred")
IDLE_UNITS = ("sec", "min")
PATTERN_TYPES = ("wildcard", "regex", "exact")
LANGUAGES = ("auto", "en", "hi_IN", "ta_IN")
HEX_COLOR = r"^#[0-9a-fA-F]{6}$"
MAX_PATTERN_LENGTH = 500
MAX_RULES = 200
MAX_ITEMS_PER_HOST = 10
MAX_SELECTORS = 6
MAX_SELECTOR_LENGTH = 2000
MAX_NAME_LENGTH = 100
NESTED_QUANTIFIER = (r"([+*?])\s*[)]\s*[+*?{]", r"([+*?{])\s*\1")
BLUR_MODE_MIGRATION = {"gaussian": "blur", "masked": "censored", "solid": "censored"}
PII_MODE_MIGRATION = {"gaussian": "blur", "asterisked": "starred", "hidden": "starred"}
BLUR_TYPE_MIGRATION = {"gaussian": "blur"}
PICKER_MODE_MIGRATION = {"sticky": "sticky-page"}

IDLE_MIN_SECONDS, IDLE_MAX_SECONDS, IDLE_DEFAULT_SECONDS = 15, 3600, 300
URL_CHANGE_QUIET_MS = 150
BUDGET_MULTIPLIER = 1.25
