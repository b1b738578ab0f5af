"""Word lists and cue tables of the text functions (fixed values: results depend on them)."""

CONTENT_STOPWORDS = (
    "a an and are as at be been being both but by can could did do does for from had has have how if in into is it its may might "
    "must no not of on or other our over same should so some such than that the their them then there these they this those "
    "through to under up use used using was we were what when where which while who why will with within would"
).split()

TERM_STOPWORDS = (
    "a about above after again against all am an and any are arent as at be because been before being below between both but by "
    "can cannot could couldnt did didnt do does doesnt doing dont down during each few for from further had hadnt has hasnt have "
    "havent having he hed hell hes her here heres hers herself him himself his how hows i id ill im ive if in into is isnt it its "
    "itself lets me more most mustnt my myself no nor not of off on once only or other ought our ours ourselves out over own same "
    "shant she shed shell shes should shouldnt so some such than that thats the their theirs them themselves then there theres "
    "these they theyd theyll theyre theyve this those through to too under until up very was wasnt we wed well were werent weve "
    "what whats when whens where wheres which while who whos whom why whys with wont would wouldnt you youd youll your youre yours "
    "yourself yourselves many much tell explain describe give show list name say says said document documents paper report section "
    "sections chapter page pages paragraph text according mention mentions"
).split()

QUERY_STOPWORDS = "a an and are as at be by does do for from how in is it its of on or the to two was what when where which who why with".split()

QUESTION_WORDS = "how often many much long frequently frequency interval period what when where which why who whom whose does do did is are was were the a an of in on for to at by".split()

GENERIC_TERMS = (
    "report reports reported document documents describe described describes say says said state states stated mention mentions "
    "mentioned about given according text passage figure figures value values information provide provides provided indicate "
    "indicates indicated specify specifies specified exact exactly kind type sort main primarily generally name named called compare "
    "contrast difference differences steps step procedure process explain explanation list enumerate happen happens happened example "
    "examples reason reasons importance role work works why"
).split()

STRUCTURAL_TERMS = "section sections content covered covers discussed listed comes boundary between near looking table show detailed full context metric monetary amount count".split()

QUANTITY = r"(?i)how (?:much|many)\b|what (?:is|was|were) the (?:value|number|amount|percentage|total|size|count)\b|what percentage\b|what proportion\b"

SUFFIXES = ["ations", "ation", "ions", "ion", "ing", "ed", "es", "s"]

QUESTION_CUES = [
    ("derivation", ["calculate", "compute", "derive", "solve", "prove", "evaluate the integral"]),
    ("comparison", ["compare", "contrast", "difference between", "differences between", "versus", " vs "]),
    ("enumeration", ["list ", "enumerate", "name the", "what are the", "state the"]),
    ("process", ["how does", "how do", "steps", "process", "procedure", "workflow", "explain how"]),
    ("definition", ["what is", "what are", "define", "definition of", "meaning of"]),
]

MEDIA_CUES = (
    "image,video,photo,picture,media,deepfake,fake,synthetic,manipulated,verify,verification,authentic,authenticity,"
    "check image,check video,check photo,is this real,is this fake,is this ai,lip sync,blink rate,face"
).split(",")
SUMMARY_CUES = "summarize,summary,summarise,summarisation,overview,recap,brief,condensed,tldr,tl;dr,short version,key points".split(",")
SEARCH_CUES = "search,find,look for,locate,search for,find mentions,find references,find all,where is,where are,contains".split(",")
PHRASE_CUES = (
    "when did,when was,when were,when is,who was,who is,who were,who wrote,what is,what are,what was,what were,what does,how many,"
    "how much,how did,how does,how long,where did,where was,where are,why did,why does,why is,can you,could you,tell me,according to,"
    "based on,in the document,in the file,in this,from the,mentioned in"
).split(",")
FIRST_WORDS = "who what when where why how which whom whose".split()
FOLLOWUP_CUES = (
    "and ,also ,what about,how about,why,how so,then ,else,it ,its ,that ,those ,these ,they ,them ,the same,more on,explain that,elaborate,go on,continue"
).split(",")
FOLLOWUP_WORDS = 6
QUERY_CHARS = 600

SPATIAL = r"(?i)\b(?:above|below|left|right|beside|column|columns|layout|chart|charts|figure|diagram|table|tables|caption)\b"
COMMANDS = r"(?i)\b(define|describe|explain|compare|contrast|evaluate|discuss|derive|calculate|list|justify|analyse|analyze)\b"
ORDINALS = {"first": 1, "second": 2, "third": 3, "fourth": 4, "fifth": 5, "sixth": 6, "seventh": 7, "eighth": 8, "ninth": 9, "tenth": 10, "last": -1, "final": -1}
RELATION_WEIGHTS = {"NEXT": 1.0, "PREV": 1.0, "SAME_PAGE": 0.7, "SAME_SECTION": 0.5}
RELATION_PRIORITY = {"NEXT": 0, "PREV": 1, "SAME_PAGE": 2, "SAME_SECTION": 3}
ENTITY_STOPWORDS = "a an and are as at be by did do does for from how in is it of on or that the their them this to was were what when where which who why with".split()

# Fixed values of claim checks: abbreviations that end no sentence, and the words that carry negation, quantity, direction and cause.
ABBREVIATIONS = "dr mr mrs ms prof rev sr jr st hon vs e.g i.e cf al fig eq sec dept est u.s u.k u.n e.u u.s.a a.m p.m".split()
CLAIM_NEGATIONS = "not no never cannot can't doesn't don't isn't aren't wasn't weren't without nor none".split()
CLAIM_QUANTIFIERS = "every each per all any some".split()
NUMBER_WORDS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10", "eleven": "11", "twelve": "12", "thirteen": "13", "fourteen": "14", "fifteen": "15",
    "sixteen": "16", "seventeen": "17", "eighteen": "18", "nineteen": "19", "twenty": "20", "thirty": "30", "forty": "40", "fifty": "50", "sixty": "60", "ninety": "90", "hundred": "100",
}
CLAIM_UNITS = "days weeks months years hours minutes seconds volts amps watts million billion thousand percent %".split()
CLAIM_COMPARATIVES = ["cheaper", "faster", "slower", "more accurate", "less accurate", "more expensive"]
CLAIM_INTENSIFIERS = "always never often sometimes usually typically generally only especially necessarily still even also all both roughly about approximately nearly almost quite very just".split()
CLAIM_UNIVERSALS = ["always", "invariably", "in every case", "in all cases"]
CLAIM_CAUSES = ["cause", "causes", "caused", "causing", "leads to", "lead to", "results in", "result in", "prevents", "prevent", "because", "due to", "as a result"]
BINDING_GENERIC = (
    "what which who whom whose when where why how according document table say says reported value amount much many does do did is was were are be been being the a an "
    "of for to in on at by with from about as that this these those it its"
).split()
BINDING_MONEY = "monetary revenue income amount total sales profit price fee".split()
BINDING_PERCENT = "percentage percent rate".split()
BINDING_CHANGE = "increase decrease change growth grew rise fall decline".split()
BINDING_VALUE_CUES = "much many amount value values total cost price number count percent percentage rate min max mean median score revenue".split()
BINDING_VALUE_COLUMNS = "amount value total cost price revenue income salary min max mean median percent percentage rate count number unit usd score qty quantity growth".split()
SHORT_UNITS = "km hpa usd req min kg cm mm mb gb ms m".split()
