"""Every pattern, word list, lookup table and limit the engine must honour.

The patterns are written in the plain ECMAScript-like form in which the rules
are specified (ASCII ``\\b``, Unicode-aware ``\\s``, absolute ``$``).
``veil.functions.text.jvm`` turns one into the Java dialect that Spark runs.
Values only, no logic.
"""

# --- fixed values: personal data types ----------------------------------------------

# Tie order: the more specific type wins when scores are equal.
PII_TYPES = ["PASSWORD", "OTP", "CVV", "CARD", "EMAIL", "PHONE", "ADDRESS"]
PLACEHOLDER_ANY = r"^\[[A-Z]+_\d+\]$"
PLACEHOLDER_KNOWN = r"^\[(EMAIL|PHONE|CARD|CVV|OTP|PASSWORD|ADDRESS)_\d+\]$"
PLACEHOLDER_IN_TEXT = r"\[(EMAIL|PHONE|CARD|CVV|OTP|PASSWORD|ADDRESS)_\d+\]"

# --- fixed values: free-text patterns --------------------------------------------------

EMAIL = r"(?i)[A-Z0-9._%+-]+@[A-Z0-9-]+(?:\.[A-Z0-9-]+)*\.[A-Z]{2,}"
CARDS = [
    r"(?<!\d)(?:\d{4}[ -]?){3}\d{4}(?:[ -]?\d{1,3})?(?!\d)",
    r"(?<!\d)\d{4}[ -]?\d{6}[ -]?\d{5}(?!\d)",
    r"(?<!\d)\d{13,19}(?!\d)",
]
PHONES = [
    r"(?<![\d+])(?:\+?91[\s-]?)?[6-9]\d{4}[\s-]?\d{5}(?!\d)",
    r"(?<!\d)\+\d{1,3}[\s-]?\(?\d{2,4}\)?[\s-]?\d{3,4}[\s-]?\d{3,4}(?!\d)",
    r"(?<!\d)\(?\d{3}\)?[\s-]\d{3}[\s-]\d{4}(?!\d)",
]
LABELLED = (
    r"(?i)\b(otp|one[\s-]?time (?:code|password)|verification code|passw(?:or)?d|passcode|cvv|cvc"
    r"|card(?: number| no\.?)?|phone|mobile|e-?mail"
    r"|(?:shipping |delivery |billing |home |street )?address)"
    r"\s*[:=]\s*([^\s,;|]+(?:[ \-]\d{3,6}){0,4}|(?:[^\n,;|]{6,120}))"
)
# (label, type, shape of an in-line labelled value)
LABELLED_SHAPES = [
    (r"(?i)^(otp|one|verification)", "OTP", r"^\d{4,8}$"),
    (r"(?i)^pass", "PASSWORD", r"^\S{4,}$"),
    (r"(?i)^cv", "CVV", r"^\d{3,4}$"),
    (r"(?i)^card", "CARD", r"^(?:\d[ -]?){12,18}\d$"),
    (r"(?i)^phone|^mobile", "PHONE", r"^\+?[\d ()-]{8,16}$"),
    (r"(?i)^e-?mail", "EMAIL", r"(?i)^[^@\s]+@[^@\s]+\.[a-z]{2,}$"),
    (r"(?i)address$", "ADDRESS", r"(?i)^(?=.*[a-z])(?=.*\d).{6,120}$"),
]
IDENTIFIER_BEFORE = r"(?i)\b(order|invoice|ref(erence)?|tracking|txn|transaction|receipt|ticket)\b[^\n]{0,20}$"
PHONE_BEFORE = r"(?i)\b(phone|mobile|tel|call|contact|whatsapp)\b"
CONTEXT_WINDOW = 40

# Patterns of the independent verifier, kept apart from the detector's on purpose.
LEAK_CARD = r"(?<!\d)(?:\d[ -]?){12,18}\d(?!\d)"
LEAK_MOBILE = r"(?<![\d+])(?:\+?91[\s-]?)?[6-9]\d{4}[\s-]?\d{5}(?!\d)"

# --- fixed values: form fields ------------------------------------------------------------

STRONG, MEDIUM, WEAK, FIELD_THRESHOLD = 3, 2, 1, 2
INPUT_TYPE_RULES = [("password", "PASSWORD"), ("email", "EMAIL"), ("tel", "PHONE")]
AUTOCOMPLETE_RULES = [
    ("email", "EMAIL"), ("tel", "PHONE"), ("tel-national", "PHONE"), ("cc-number", "CARD"),
    ("cc-csc", "CVV"), ("one-time-code", "OTP"), ("current-password", "PASSWORD"),
    ("new-password", "PASSWORD"), ("street-address", "ADDRESS"),
    ("address-line1", "ADDRESS"), ("address-line2", "ADDRESS"),
]
KEYWORD_RULES = [
    (r"(?i)\bpassw(?:or)?d\b|\bpasscode\b", "PASSWORD"),
    (r"(?i)\botp\b|\bone[\s_-]?time\b|\bverification code\b", "OTP"),
    (r"(?i)\bcv[vc]2?\b|\bsecurity code\b", "CVV"),
    (r"(?i)\bcard[\s_-]?(?:number|no|num)\b|\bcc[\s_-]?(?:number|num)\b|\bcredit card\b|\bdebit card\b", "CARD"),
    (r"(?i)\be[\s_-]?mail\b", "EMAIL"),
    (r"(?i)\bphone\b|\bmobile\b|\btel\b|\btelephone\b|\bcontact number\b|\bwhatsapp\b", "PHONE"),
    (r"(?i)(?<!e[\s_-]?mail[\s_-])\b(?:street|shipping|billing|delivery|home|postal)?[\s_-]?address\b", "ADDRESS"),
]
VALUE_SHAPES = [
    (r"(?i)^[A-Z0-9._%+-]+@[A-Z0-9-]+(?:\.[A-Z0-9-]+)*\.[A-Z]{2,}$", "EMAIL"),
    (r"^(?:\+?91[\s-]?)?[6-9]\d{4}[\s-]?\d{5}$", "PHONE"),
    (r"^\d{3,4}$", "CVV"),
    (r"^\d{4,8}$", "OTP"),
]
TYPE_SHAPES = [
    ("OTP", r"^\d{4,8}$"),
    ("CVV", r"^\d{3,4}$"),
    ("CARD", r"^(?:\d[ -]?){12,18}\d$"),
    ("PHONE", r"^\+?[\d ()-]{8,16}$"),
    ("EMAIL", r"(?i)^[^@\s]+@[^@\s]+\.[a-z]{2,}$"),
    ("PASSWORD", r"^(?=.*[\d•*#@!$%^&_])\S{4,}$"),
    ("ADDRESS", r"(?i)^(?=.*[a-z])(?=.*\d).{6,120}$"),
]
BUTTON_INPUT_TYPES = ["submit", "button", "reset", "image", "checkbox", "radio", "file", "range", "color"]
NEARBY_MAX = 40

# --- fixed values: outgoing payload contract -----------------------------------------------

REQUEST_KEYS = ["task", "page", "placeholders"]
REQUEST_OPTIONAL = ["visual", "history", "guidance"]
PAGE_KEYS = ["url", "title", "elements", "text"]
ELEMENT_KEYS = ["id", "tag", "text", "role"]
ELEMENT_OPTIONAL = ["context", "options"]
HISTORY_KEYS = ["action", "target", "value"]
HISTORY_OPTIONAL = ["effect", "note"]
VISUAL_KEYS = ["engine", "observations", "conflicts"]
OBSERVATION_KEYS = ["type", "text", "bbox", "confidence", "target"]
BBOX_KEYS = ["x", "y", "width", "height"]
ACTIONS = ["click", "type", "press", "scroll", "select", "navigate", "done"]
EFFECTS = ["url_changed", "dom_changed", "no_change", "unknown"]
OBSERVATION_TYPES = ["text", "price", "button", "input"]
MAX_GUIDANCE, MAX_NOTE, MAX_HISTORY_VALUE, MAX_HISTORY = 400, 200, 200, 20
MAX_CONTEXT, MAX_OPTIONS, MAX_OPTION = 160, 30, 60
MAX_OBSERVATION_TEXT, MAX_STRING = 500, 32000
HISTORY_KEPT = 10
MIN_KNOWN, MIN_KNOWN_DIGITS = 3, 6
IMAGE_DATA = r"(?i)data:\s*image\/|base64,|image\/(png|jpe?g|webp)|\\u0089PNG|\bPNG\b.{0,4}IHDR"
BASE64_RUN = r"[A-Za-z0-9+/]{400,}={0,2}"
BLOCK_PREFIX = "Privacy Firewall blocked request"

# --- fixed values: lines, boxes, prices ----------------------------------------------------

MIN_CONFIDENCE = 0.55
MERGE_IOU, MERGE_CONTAINMENT, COLUMN_GAP_FACTOR = 0.3, 0.7, 1.5
MAX_NAME_DISTANCE = 90.0
MAX_LABEL_WORDS, MAX_LABEL_CHARS = 4, 40
MAX_ROW_GAP, MAX_STACK_GAP, MIN_ROW_OVERLAP, MIN_COLUMN_OVERLAP = 700.0, 70.0, 0.5, 0.3
MASK_PADDING = 3.0
CURRENCY_AMOUNT = r"(?i)(?:₹|rs\.?|inr|\$|€|£)\s?\d[\d,]*(?:\.\d+)?"
PRICE_LABEL = r"(?i)^price\b"
PRICE_LABEL_DIGITS = r"(?i)^price\s*[:\-]?\s*\S{0,2}\s?\d{2,}"
TRAILING_AMOUNT = r"(\d[\d,]*)(?:\.\d+)?\s*$"
DOM_PRICE = (
    r"(?i)([^\n]{3,60}?)\s*\n+\s*(?:price\s*[:\-]?\s*(?:₹|rs\.?|inr|\$|€|£)?|(?:₹|rs\.?|inr|\$|€|£))\s?(\d[\d,]*)"
)

# --- fixed values: page elements --------------------------------------------------------------

MAX_PAGE_TEXT, MIN_MAIN_TEXT, MAX_LABEL, MAX_ELEMENTS = 30000, 200, 200, 220
CHROME_TAGS = ["nav", "header", "footer", "aside"]
CHROME_ROLES = ["navigation", "banner", "contentinfo", "complementary"]
MAIN_TAGS, MAIN_ROLES = ["main"], ["main"]
SLUG_MAX, WRAPPER_LABEL_MAX, WRAPPER_DEPTH = 32, 60, 3
CARD_LABEL_MAX, CARD_DEPTH, CARD_TEXT_MAX, CARD_CONTEXT_MAX, CARD_LINK_MIN = 30, 12, 6000, 120, 15
CARD_PRICE = r"(?i)(?:₹|(?<![a-z])rs\.?|(?<![a-z])inr|\$|€|£)\s?\d[\d,]*(?:\.\d+)?"
GLYPH_WORDS = [
    ("✕✖✗✘×⨯╳❌", "close"), ("←⟵◀◁‹«", "back"), ("→⟶▶▷›»", "next"),
    ("☰≡", "menu"), ("🔍🔎", "search"), ("🛒", "cart"), ("♡♥❤", "wishlist"),
]
VOLATILE = [
    r"\b\d{1,2}\s*h(?:rs?|ours?)?\s*\d{1,2}\s*m(?:in|ins)?(?:\s*\d{1,2}\s*s(?:ec|ecs)?)?\b",
    r"\b\d{1,2}\s*[hms]\b",
    r"\b\d{1,2}:\d{2}(?::\d{2})?\s*(?:am|pm)?\b",
    r"\b\d+\s*(?:more|left|sold|remaining|viewing|views?|likes?|reviews?|ratings?|bought|orders?)\b",
    r"\b(?:\d+\s*)?(?:sec|secs|second|seconds|min|mins|minute|minutes|hour|hours|day|days|week|weeks)\s*(?:ago|left|remaining)\b",
    r"\b(?:ends?|ending|expires?|closing)\s+in\b[^,;|]{0,20}",
    r"\b\d{1,3}\s*%\s*(?:off|claimed|sold)?\b",
    r"\b(?:just now|today|yesterday|tomorrow)\b",
]
SIMILAR_PREFIX_MIN, SIMILARITY_MIN = 8, 0.6
SIGNATURE_CONTROLS = 300
SECOND_LEVEL_SUFFIXES = ["co", "com", "org", "net", "ac", "gov", "edu", "or", "ne", "go"]

# --- fixed values: action policy ------------------------------------------------------------------

ACTION_FIELDS = ["action", "target", "value", "confidence", "reason", "final"]
TARGET_FORMAT = r"^el_[a-z0-9_]{1,64}$"
EXECUTABLE_CONTENT = r"(?i)<\s*script|javascript:|vbscript:|data:\s*text\/html|\bon[a-z]+\s*="
SAFE_NAVIGATION = r"(?i)^https?:\/\/[^\s]+$"
SCROLL_VALUES = ["up", "down", "top", "bottom"]
TARGET_ACTIONS = ["click", "type", "press", "select"]
VALUE_ACTIONS = ["type", "press", "select", "navigate"]
TYPEABLE_TYPES = ["text", "email", "tel", "password", "search", "url", "number", ""]
STOP_CODES = ["MISSING_REQUIRED_DATA", "AMBIGUOUS_TARGET", "INSUFFICIENT_EVIDENCE"]
OUTCOME_BY_CODE = {
    "unknown_target": "STALE_TARGET", "incompatible_target": "STALE_TARGET", "target_not_clickable": "STALE_TARGET",
    "target_occluded": "TARGET_OCCLUDED", "ambiguous_target": "AMBIGUOUS_TARGET",
    "unsupported_action": "UNSUPPORTED_ACTION", "unsupported_by_executor": "UNSUPPORTED_ACTION",
    "repeated_action": "REPEATED_ACTION", "consequential_action": "SAFETY_BLOCK",
    "navigation_not_authorised": "SAFETY_BLOCK", "sensitive_policy": "SAFETY_BLOCK",
    "dangerous_navigation": "SAFETY_BLOCK",
}
OUTCOME_OTHER, OUTCOME_NONE = "INVALID_MODEL_RESPONSE", "UNKNOWN_ERROR"
ERROR_RULES = [
    (r"privacy firewall|leakage", "PRIVACY_BLOCK"),
    (r"timed? ?out|timeout|aborted", "CLOUD_TIMEOUT"),
    (r"invalid action from reasoning provider|not valid json|does not match the contract|unusable action", "INVALID_MODEL_RESPONSE"),
    (r"failed to fetch|networkerror|network error|econnrefused|could not connect|fetch failed", "NETWORK_ERROR"),
    (r"backend returned \d{3}|reasoning provider error|cloud reasoner unavailable|quota", "CLOUD_ERROR"),
    (r"could not establish connection|receiving end does not exist|message port closed|no active tab|cannot access|frame was removed|no web page|execution context was destroyed|because of a navigation", "PAGE_UNAVAILABLE"),
    (r"page extraction failed|extract", "PAGE_UNAVAILABLE"),
]
# (category, intents named in a task, labels of a control)
CONSEQUENTIAL_RULES = [
    ("purchase", r"(?i)\b(buy|purchase|order it|place (an |the |my )?order)\b",
     r"(?i)\b(buy( it)? now|buy|purchase|place (your |the )?order|order now|complete (the )?purchase|confirm (the )?order)\b"),
    ("checkout", r"(?i)\b(check ?out|proceed to (checkout|pay))\b",
     r"(?i)\b(check ?out|proceed to (checkout|pay|payment|buy))\b"),
    ("payment", r"(?i)\b(pay|payment|make (a |the )?payment)\b",
     r"(?i)\b(pay( now)?|make payment|pay with|confirm payment)\b"),
    ("account", r"(?i)\b(sign ?in|log ?in|log ?on|register|sign ?up|create (an |my )?account)\b",
     r"(?i)\b(sign ?in|log ?in|log ?on|register|sign ?up|create (an |your )?account|continue with (google|apple|facebook))\b"),
    ("destructive", r"(?i)\b(delete|remove|cancel|unsubscribe|deactivate|close (my |the )?account)\b",
     r"(?i)\b(delete|remove|cancel (order|subscription|account)|unsubscribe|deactivate|close account)\b"),
    ("submit", r"(?i)\b(submit|send|post|apply|confirm)\b", r"(?i)\b(submit|send|post|apply now|confirm)\b"),
]
NEGATION = r"(?i)\b(do not|don't|dont|never|without|not|no)\b"
SENTENCE_BREAK = r"[.!?;\n]+"
CART_ADD_LABEL = r"(?i)\b(add(ed)? to (cart|bag|basket|trolley))\b"
CART_ADD_LIMIT = 2
MULTIPLE_ITEMS = r"(?i)\b([2-9]|[1-9]\d+|two|three|four|five|six|both|multiple|several|each|all|pairs?|sets?|pack of)\b"

# --- fixed values: task safety vocabulary ----------------------------------------------------------

_HARM_STEMS = [
    "kill", "murder", "hurt", "harm", "injur", "stab", "shoot", "poison", "strangl", "chok", "assault", "attack",
    r"beat\s+up", "beat", "tortur", "rape", "kidnap", "abduct", "maim", "drown", "suffocat", "slaughter", "butcher",
    "behead", "execut", r"blow\s+up", "bomb", "burn", r"set\s+fire\s+to", r"run\s+over", r"cut\s+up", "wound",
    "cripple", "smash", "bash", "slash", "slit", "electrocut", "gas", "shank",
]
_HARM_VERB = "(?:" + "|".join(_HARM_STEMS) + ")(?:e|es|s|ed|ing|ping|ted|ting|ning|ling|ering)?"
_HARM_NOUN = "(?:violence|revenge|murder|assault|torture|abuse|a beating|bodily harm|physical harm|serious harm|injury|injuries)"
_WEAPON = (
    "(?:knife|knives|blade|blades|dagger|gun|guns|firearm|rifle|pistol|revolver|shotgun|ammo|ammunition|bullets?|poison"
    "|toxin|weapons?|bombs?|explosives?|acid|rope|hammer|axe|hatchet|machete|sword|bat|crowbar|chloroform|drugs?|pills"
    "|sedatives?|taser|pepper spray|brass knuckles|chain|chains|wire|syringe|needle|blowtorch)"
)
_UNNAMED = (
    "(?:something|anything|an item|some item|a thing|things|stuff|a tool|tools|an object|a product|products|a device"
    "|supplies|what i need|whatever i need)"
)
_OBJECT = f"(?:{_WEAPON}|{_UNNAMED})"
_PURPOSE = (
    "(?:to|for|so (?:that )?(?:i|we) (?:can|could|may)|in order to|that (?:i|we) can use to|(?:i|we) can use to"
    "|(?:i|we) could use to|which (?:i|we) can use to|to use (?:on|against)|for use (?:on|against)|capable of|good for"
    "|that (?:can|will|would))"
)
_PERSON = (
    "(?:friend|friends|wife|husband|partner|girlfriend|boyfriend|ex|neighbou?rs?|boss|teacher|coworkers?|colleagues?"
    "|classmates?|roommates?|landlord|someone|somebody|anyone|anybody|everyone|everybody|people|person|persons|him|her"
    "|them|kids?|child|children|baby|family|brother|sister|mother|father|mom|dad|parents?|son|daughter|uncle|aunt|cousin"
    "|guy|girl|man|woman|men|women|boy|boys|girls|dog|cat|pet|pets|animal|animals|bird|birds|stranger|strangers|crowd"
    "|customer|customers|myself|me|himself|herself|themselves|a human|humans|the police|officer|officers)"
)
_TARGET = f"(?:my |his |her |their |our |the |a |that |this |some |these |those |an )?{_PERSON}"
_INTIMIDATION = (
    r"(?:teach (?:\w+ ){0,3}a lesson|get back at|get even with|revenge on|payback|make (?:\w+ ){0,3}pay"
    r"|make (?:\w+ ){0,3}suffer|scare|threaten|intimidate|silence|get rid of|take care of|deal with"
    r"|settle (?:the )?score|punish|finish off|sort out)"
)
GUARD = {
    "self_harm": r"\b(?:kill(?:ing)? myself|end(?:ing)? my (?:own )?life|commit(?:ting)? suicide|suicide|hang(?:ing)? myself"
                 r"|cut(?:ting)? myself|overdose|overdosing|hurt(?:ing)? myself|harm(?:ing)? myself|take my (?:own )?life"
                 r"|self[- ]harm|end it all)\b",
    "dangerous_device": r"\b(?:make|build|assemble|buy|get|acquire|order|purchase|find)\b[^,]{0,30}\b(?:a |an |the )?"
                        r"(?:pipe bomb|bomb|explosive|explosives|nerve agent|bioweapon|ghost gun|molotov|ied|detonator|silencer for)\b",
    "negated": r"\b(?:not|never|cannot|can't|won't|wouldn't|don't|doesn't|didn't|no|without|avoid|prevent|stop"
               r"|protect(?:ed|s|ing)? (?:\w+ )?from)\b(?:\s+\w+){0,3}?\s+"
               rf"(?:{_HARM_VERB}|{_HARM_NOUN})\b",
    "benign": r"\b(?:kill|attack|beat|shoot|burn|cut|execute|bomb|smash|bash|slash|crush|choke|gas|hammer|drown|strangle)\w*\b"
              r"[^,]{0,20}?\b(?:process|processes|task|tasks|job|jobs|time|bug|bugs|weeds|germs|bacteria|mold|mould|calories"
              r"|photo|photos|video|videos|picture|pictures|ball|problem|problems|record|records|score|level|boss level|fat"
              r"|match|game|games|deadline|it off|off|switch|command|server|app|the lights|the engine|onions|vegetables"
              r"|the cake|wood|paper|cardboard|bread|cheese|grass|the lawn|the competition|the deal|a workout|the gym"
              r"|an audition|the exam|the interview)\b",
    "verb_target": rf"\b{_HARM_VERB}\b[^,]{{0,40}}?\b{_TARGET}\b",
    "noun_target": rf"\b{_HARM_NOUN}\b[^,]{{0,30}}?\b(?:on|to|against|toward|towards|for|at)\b\s+{_TARGET}\b",
    "object_purpose": rf"\b{_OBJECT}\b[^,]{{0,60}}?\b{_PURPOSE}\b[^,]{{0,25}}?\b(?:{_HARM_VERB}|{_HARM_NOUN})\b",
    "harm_with": rf"\b(?:{_HARM_VERB}|{_HARM_NOUN})\b[^,]{{0,30}}?\b(?:with|using)\b\s+(?:a |an |the |some |my )?{_WEAPON}\b",
    "targeting": r"\b(?:stalk(?:ing)?|track(?:ing)?(?:\s+down)?|spy(?:ing)?\s+on|hack(?:ing)?(?:\s+into)?|drug(?:ging)?"
                 rf"|dox(?:x)?(?:ing)?|swat(?:ting)?|blackmail(?:ing)?|kidnap(?:ping)?|groom(?:ing)?)\s+{_TARGET}\b",
    "object": rf"\b{_OBJECT}\b",
    "substance": r"\b(?:throw|throwing|splash|splashing|spray|spraying|pour|pouring)\b[^,]{0,25}?"
                 rf"\b(?:on|at|over|in the face of|into the eyes of)\b\s+{_TARGET}\b",
    "intimidation": rf"\b{_INTIMIDATION}\b",
    "person": rf"\b{_TARGET}\b",
}

# --- fixed values: task facts and completion --------------------------------------------------------

_QUALIFIER = (
    r"(around|about|approximately|approx\.?|near|roughly|under|below|less than|at most|max(?:imum)?|within"
    r"|over|above|more than|at least|min(?:imum)?|for|at|of)?"
)
_AMOUNT = r"(\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?"
PRICE_BEFORE_AMOUNT = rf"(?i){_QUALIFIER}\s*((?:₹|rs\.?|inr|\$|€|£|usd|eur|gbp))\s*{_AMOUNT}"
PRICE_AFTER_AMOUNT = rf"(?i){_QUALIFIER}\s*{_AMOUNT}\s*(rupees|rs|dollars|euros|pounds)"
PRICE_KINDS = [
    (r"around|about|approx|near|roughly", "around"),
    (r"under|below|less|most|max|within", "max"),
    (r"over|above|more|least|min", "min"),
]
CURRENCY_NAMES = [("₹", r"^(₹|rs.*|inr|rupees)$"), ("$", r"^(\$|usd|dollars)$"), ("€", r"^(€|eur|euros)$"), ("£", r"^(£|gbp|pounds)$")]
QUANTITY = (
    r"(?i)\b(\d{1,6})\s*(?:units?|pieces?|pcs|items?|qty|quantity|copies|packs?|pairs?|bottles?|boxes?)\b"
    r"|\b(?:quantity|qty)\s*(?:of|to|=|:)?\s*(\d{1,6})\b|\badd\s+(\d{1,6})\s+(?:of\b|to\b)"
)
AROUND_TOLERANCE, EXACT_TOLERANCE = 0.2, 0.1
TIE_BREAKER = r"(?i)\b(tie|tied|if (?:two|several|more than one|both)|same price|equal price|otherwise|prefer|in that case)\b"

_CART = "(?:cart|bag|basket|trolley)"
CART_ADD = rf"(?i)\badd(?:ed|ing)?\b[^.]{{0,60}}?\bto (?:the |my |your )?{_CART}\b"
CART_PUT = rf"\b(?:put|place)\b[^.]{{0,30}}\bin (?:the |my )?{_CART}\b"
CART_WORD = r"(?i)cart|bag|basket|trolley"
CART_COUNTS = [
    rf"(?i)(\d+)\s*(?:items?|products?)?\s*(?:in|added to)\s+(?:your |the |my )?{_CART}\b",
    rf"(?i)\b{_CART}\b\D{{0,3}}(\d+)\b",
    rf"(?i)\b(\d+)\s*\b{_CART}\b",
]
CART_COUNT_TEXT_BOUND = 1000
GO_TO_CART = rf"(?i)^(?:go to|view|open|see|proceed to)\s+(?:your |the |my )?{_CART}\b|^{_CART}\s*\(\d+\)"
CART_CONFIRMATION = rf"(?i)\badded to (?:your |the |my )?{_CART}\b|\bitems? added\b|\bin your {_CART}\b|\bsuccessfully added\b"
GOAL_RULES = [
    ("purchase", r"\b(buy|purchase|order|checkout|check out|pay for)\b"),
    ("search", r"\b(search|find|look for|look up|show me|locate|browse for)\b"),
    ("open", r"\b(open|go to|visit|navigate to|load)\b"),
]
PURCHASE_LABEL = r"(?i)\b(buy( it)? now|buy|purchase|place (your |the )?order|order now|check ?out|proceed to (checkout|pay|payment|buy))\b"
CHECKOUT_STATE = r"(?i)checkout|payment|\bpay\b|order|purchase|\bbuy\b|address|shipping"
ORDER_CONFIRMED = r"order (?:placed|confirmed)|thank you for your (?:order|purchase)"
SEARCH_CONTROL = r"(?i)\b(search|go|find|submit|lookup|look up)\b|^🔍$|magnif"
QUERY_PARAMS = ["q", "query", "search", "k", "s", "keyword", "keywords", "term", "text", "searchterm", "search_query", "field-keywords"]
RESULTS_TEXT = r"(?i)\bresults?\b|\bshowing\b|\bfound\b"
RESULTS_URL = r"search|results|\?q=|\?k=|query="
SHOWN_QUANTITY = r"(?i)\b(?:qty|quantity)\s*[:=]?\s*(\d{1,6})\b|\b(\d{1,6})\s*(?:units?|pcs|pieces?)\b|[x×]\s*(\d{1,6})\b"
STOPWORDS = [
    "the", "and", "for", "with", "from", "that", "this", "open", "page", "site", "website", "then", "please", "into",
    "onto", "about", "search", "find", "look", "show", "article", "click", "under", "over", "cheapest", "best",
]
BLOCKERS = [
    "out of stock", "sold out", "currently unavailable", "not available", "unavailable", "no longer available",
    "no results", "no matching", "notify me", "coming soon", "discontinued", "cannot be delivered", "not deliverable",
    "does not deliver", "sign in", "log in", "login", "access denied", "captcha", "verify you are human",
    "something went wrong", "error", "minimum order", "not eligible", "restricted", "temporarily",
]

# --- fixed values: run budgets and timings -------------------------------------------------------------

MAX_STEPS, MAX_ROUNDS, MAX_RECOVERIES, MAX_FAILED, MAX_REPEAT_WARNINGS, MAX_POLICY_RECOVERIES = 30, 3, 3, 2, 1, 1
CYCLE_WINDOW, CYCLE_COUNT, NO_EFFECT_STREAK = 8, 3, 3
SETTLE_QUIET_MS, SETTLE_GRACE_MS, SETTLE_MAX_MS = 300, 2000, 3500
EFFECT_WATCH_MS, EFFECT_QUIET_MS, EVIDENCE_MS = 1500, 250, 3000
IOU_MATCH, COVER_MATCH = 0.5, 0.9
