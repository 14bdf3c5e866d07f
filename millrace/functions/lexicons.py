"""Word lists, character sets and patterns of the text filters.

Fixed values: results depend on them, so they are given as they are.
"""

import string

#: Characters stripped from both ends of a word, beside punctuation, digits and white space.
OTHER_SPECIAL_CHARACTERS = '\x92\u2009\x93\x97\u200a\x9d\x99\u202f\x96\u2005\x95\x91\x9c\u3000\u2002 \u2008\x98\x81\u2003\x82￼\x83\x84’“”–ー一▬…✦�\xad£\u200b•€«»°·═×士＾˘⇓↓↑←→（）§″′´¿−±∈\ufeff¢ø‚„½¼¾¹²³―⁃，ˌ¸‹›ʺˈʻ¦‐⠀‰\x85\x85‑≤≥‖◆●■►▼▲▴∆▻¡★☆✱ːº。¯˜¥ɪ≈†上ン：∼⁄・♡✓⊕․．⋅÷１‟；،、¨ाাी्े◦˚゜ʼ≖ʼ¤ッツシ℃√！【】‿∞➤～πه۩☛₨➩☻๑٪♥ıॽ《‘©﴿٬？▷Г♫∟™ª₪®「—❖」﴾》'
SPECIAL_CHARACTERS = "".join(sorted(set(string.punctuation + string.digits + string.whitespace + OTHER_SPECIAL_CHARACTERS)))
#: Adult words.
FLAGGED_WORDS = (
    "anal", "bareback", "bbw", "bdsm", "blowjob", "blowjobs", "brazzers", "bukkake", "camgirl", "camwhore", "cocksucking", "creampie", "cuckold", "cum", "cumming", "cums", "cumshot", "cumshots", "cumslut", "cunnilingus", "deepthroat", "deepthroating", "dildo", "dildos", "dogging", "doggystyle", "dominatrix", "erotic", "fellatio", "femdom", "fingering", "fisting", "footjob", "gangbang", "handjob", "hentai", "horney", "horniest", "horny", "jism", "jizz", "masterbating", "masturbate", "masturbating", "masturbation", "milf", "orgies", "orgy", "pegging", "porn", "pornhub", "porno", "pornos", "pornstar", "pornstars", "redtube", "rimming", "slutty", "squirting", "strapon", "threesome", "vibrator", "xhamster", "xnxx", "xvideos", "xxx", "youporn",
)
#: Phrases of page headers and footers.
HEADER_FOOTER_KEYWORDS = (
    "We appreciate your help to end bad business websites",
    "Not Your Average WordPress Web Design Agency",
    "Subscribe to receive exclusive content and notifications",
    "Services",
    "Any questions?",
    "Downloadable software products",
    "Some health and personal care items",
    "Please contact us through our Contact Us page to open a return ticket.",
    "Top image",
    "Like Liked",
    "Looking for",
    "How do I login to my zoom account",
    "Watch on YouTube",
    "Contact Information",
    "Read More",
    "Showing 1–9 of 7361 results",
    "Call Us",
    "There are no reviews yet",
    "Related Fellow",
    "Want More",
    "More information",
    "Login and Registration",
    "Google+",
    "YouTube",
    "Subscribe",
    "Available for you in",
    "Sign in",
    "view details",
    "ID #",
    "Thank you so much for reading",
)
#: Words that end a counter of a social network.
COUNTER_ENDS = ("likes", "followers", "subscribes", "share", "comments", "comments:", "dislikes", "comment", "comment.")
#: Phrases of short calls to action.
CALLS_TO_ACTION = ("sign-in", "sign in", "sign up", "read more", "item in cart")
#: Words that a line of a social network ends with, before an optional colon.
SOCIAL_ENDS = ("references", "like", "likes", "share", "shares", "comment", "comments", "review", "reviews", "reviews about", "call us at", "email us at", "more images", "users online", "copyright", "subscribe", "subscribes")
#: Phrases anywhere in such a line.
SOCIAL_PHRASES = ("for more info", "for more detail", "top threads", "most read", "most viewed", "most shared", "most liked", "more here")
#: Words of image captions.
CAPTION_WORDS = ("download", "load", "getty", "image", "photo", "source")
#: Stop words of which a document needs two.
STOP_WORDS = ("the", "is", "are", "am", "to", "of", "and", "that", "have", "with")
#: Telephone numbers.
PHONES = (
    r"\d{3}-\d{3}-\d{4}",
    r"\(\d{3}\)\s?\d{3}-\d{4}",
)
#: Dates and times of day.
TIMES = (
    r"(?:January|February|March|April|May|June|July|August|September|October|November|December)\s\d{1,2},\s\d{4}",
    r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s\d{1,2},\s\d{4}",
    r"\d{1,2}\s(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s\d{4}",
    r"\b\d{1,2}[:.]\d{2}\s*(a|p)?\.?m\.?\b",
    r"\b([01]?[0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9])?\b",
    r"\b([01]?[0-9]|2[0-3])(:[0-5][0-9])?([ap]\.?m\.?)\b",
    r"\b([01]?[0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]\.\d{1,6}\b",
)
#: Credits of photographs.
AUTHORS = (r"\(Photo:[A-Z,a-z,\s]{0,20}\)",)
#: Publication, dates, names, addresses, telephone numbers and times of day.
CONTACTS = (
    "published on",
    "published by",
    r"\d{4}-\d{2}-\d{2}",
    r"\d{2}-\d{2}-\d{2}",
    r"\d{4}/\d{2}/\d{2}",
    r"\d{2}/\d{2}/\d{4}",
    r"(?:January|February|March|April|May|June|July|August|September|October|November|December)\s\d{1,2},\s\d{4}",
    r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s\d{1,2},\s\d{4}",
    r"\d{1,2}\s(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s\d{4}",
    r"@[a-zA-Z0-9_]+([\.-][a-zA-Z0-9_]+)*",
    r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    r"\d{3}-\d{3}-\d{4}",
    r"https?://(?:[-\w.]|(?:%[\da-fA-F]{2}))+",
    r"\b\d{1,2}[:.]\d{2}\s*(a|p)?\.?m\.?\b",
    r"\b([01]?[0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9])?\b",
    r"\b([01]?[0-9]|2[0-3])(:[0-5][0-9])?([ap]\.?m\.?)\b",
    r"\b([01]?[0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]\.\d{1,6}\b",
)
#: Lines that send the reader elsewhere, anywhere in a paragraph.
DOWNLOADS = (r"For details on the", r"the link is")
#: Thanks, publishers and credits anywhere; citations at the end of a paragraph.
SOURCES = (r"^(Special thanks)", r"Published\s*by", r"All\s*photo\s*credits\s*and\s*copyright")
CITATIONS = (r"\(cf\..*?\)$", r"\([\w\s&,]+\s*,\s*\d{4,}\)$")
#: Where sentences are split.
SENTENCE_SPLIT = r"(?<!\w\.\w.)(?<![A-Z][a-z]\.)(?<=\.|\?|\!)\s"
#: A numbered reference, and its mark in the text.
NUMBERED = r"\[\d{1,2}\]\s.*(?<=\.)"
NUMBERED_MARK = r"\s\[\d{1,2}\]"
#: Calls to read on; those with capitals match no lower-cased word.
READ_ON = (
    "read more", "more words", "read next", "learn more", "see this article", "click here", "continue reading", "Read Full Article", "See More", "Click to View Details", "Read the Rest",
    "Expand", "Show More", "Continue Browsing", "Read Next Section", "View Full Content", "Read On", "See Remaining", "Continue Watching", "Explore More",
)
#: Phrases from which on a page of a dictionary is cut, and the addresses of such pages.
DICTIONARY_PHRASES = ("word of the day", "test Your *", "keep scrolling for more", "take the quiz")
DICTIONARY_SITE = ("www.merriam-webster", "/dictionary")
#: Contractions that miss their apostrophe.
CONTRACTIONS = {
    "aint": "ain't",
    "arent": "aren't",
    "cant": "can't",
    "couldve": "could've",
    "couldnt": "couldn't",
    "couldn'tve": "couldn't've",
    "couldnt've": "couldn't've",
    "didnt": "didn't",
    "doesnt": "doesn't",
    "dont": "don't",
    "hadnt": "hadn't",
    "hadnt've": "hadn't've",
    "hadn'tve": "hadn't've",
    "hasnt": "hasn't",
    "havent": "haven't",
    "hed": "he'd",
    "hed've": "he'd've",
    "he'dve": "he'd've",
    "hes": "he's",
    "howd": "how'd",
    "howll": "how'll",
    "hows": "how's",
    "isnt": "isn't",
    "itd": "it'd",
    "itd've": "it'd've",
    "it'dve": "it'd've",
    "itll": "it'll",
    "let's": "let's",
    "maam": "ma'am",
    "mightnt": "mightn't",
    "mightnt've": "mightn't've",
    "mightn'tve": "mightn't've",
    "mightve": "might've",
    "mustnt": "mustn't",
    "mustve": "must've",
    "neednt": "needn't",
    "notve": "not've",
    "oclock": "o'clock",
    "oughtnt": "oughtn't",
    "ow's'at": "'ow's'at",
    "'ows'at": "'ow's'at",
    "'ow'sat": "'ow's'at",
    "shant": "shan't",
    "shed've": "she'd've",
    "she'dve": "she'd've",
    "she's": "she's",
    "shouldve": "should've",
    "shouldnt": "shouldn't",
    "shouldnt've": "shouldn't've",
    "shouldn'tve": "shouldn't've",
    "somebody'd": "somebodyd",
    "somebodyd've": "somebody'd've",
    "somebody'dve": "somebody'd've",
    "somebodyll": "somebody'll",
    "somebodys": "somebody's",
    "someoned": "someone'd",
    "someoned've": "someone'd've",
    "someone'dve": "someone'd've",
    "someonell": "someone'll",
    "someones": "someone's",
    "somethingd": "something'd",
    "somethingd've": "something'd've",
    "something'dve": "something'd've",
    "somethingll": "something'll",
    "thats": "that's",
    "thered": "there'd",
    "thered've": "there'd've",
    "there'dve": "there'd've",
    "therere": "there're",
    "theres": "there's",
    "theyd": "they'd",
    "theyd've": "they'd've",
    "they'dve": "they'd've",
    "theyll": "they'll",
    "theyre": "they're",
    "theyve": "they've",
    "twas": "'twas",
    "wasnt": "wasn't",
    "wed've": "we'd've",
    "we'dve": "we'd've",
    "weve": "we've",
    "werent": "weren't",
    "whatll": "what'll",
    "whatre": "what're",
    "whats": "what's",
    "whatve": "what've",
    "whens": "when's",
    "whered": "where'd",
    "wheres": "where's",
    "whereve": "where've",
    "whod": "who'd",
    "whod've": "who'd've",
    "who'dve": "who'd've",
    "wholl": "who'll",
    "whos": "who's",
    "whove": "who've",
    "whyll": "why'll",
    "whyre": "why're",
    "whys": "why's",
    "wont": "won't",
    "wouldve": "would've",
    "wouldnt": "wouldn't",
    "wouldnt've": "wouldn't've",
    "wouldn'tve": "wouldn't've",
    "yall": "y'all",
    "yall'll": "y'all'll",
    "y'allll": "y'all'll",
    "yall'd've": "y'all'd've",
    "y'alld've": "y'all'd've",
    "y'all'dve": "y'all'd've",
    "youd": "you'd",
    "youd've": "you'd've",
    "you'dve": "you'd've",
    "youll": "you'll",
    "youre": "you're",
    "youve": "you've",
}
#: Words of small numbers.
NUMBER_WORDS = {"none": "0", "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10"}
ARTICLES = ("a", "an", "the")
#: Punctuation that answers are cleared of, in this order.
PUNCTUATION = (";", "/", "[", "]", '"', "{", "}", "(", ")", "=", "+", "\\", "_", "-", ">", "<", "@", "`", ",", "?", "!")

# Words whose stem for open-ended answers is given, since rules would miss it.
STEMS = {
    "police": "police", "las": "las", "vegas": "vegas", "yes": "yes", "jeans": "jean", "hell's": "hell", "domino's": "domino", "morning": "morn", "clothes": "cloth", "are": "are",
    "riding": "ride", "leaves": "leaf", "dangerous": "danger", "clothing": "cloth", "texting": "text", "kiting": "kite", "firefighters": "firefight", "ties": "tie", "married": "married",
    "teething": "teeth", "gloves": "glove", "tennis": "tennis", "dining": "dine", "directions": "direct", "waves": "wave", "christmas": "christmas", "drives": "drive", "pudding": "pud",
    "coding": "code", "plating": "plate", "quantas": "quanta", "hornes": "horn", "graves": "grave", "mating": "mate", "paned": "pane", "alertness": "alert", "sunbathing": "sunbath",
    "tenning": "ten", "wetness": "wet", "urinating": "urine", "sickness": "sick", "braves": "brave", "firefighting": "firefight", "lenses": "lens", "reflections": "reflect",
    "controllers": "control", "weddings": "wed", "sometimes": "sometime", "earing": "ear",
}
