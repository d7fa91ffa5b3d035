"""Small fixed lookup tables shipped with the package.

Everything here is data, not logic. The tables are tiny and of fixed size,
so they are safe to embed as literals or broadcast. Larger user-supplied
tables go through the DataFrame loaders in ``kbspark.sources.tables``.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES: English stop words (the common 179-word list used by the
# original text tools). Membership is case-sensitive and lower-case only.
# ---------------------------------------------------------------------------
STOPWORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "you're",
    "you've", "you'll", "you'd", "your", "yours", "yourself", "yourselves", "he",
    "him", "his", "himself", "she", "she's", "her", "hers", "herself", "it", "it's",
    "its", "itself", "they", "them", "their", "theirs", "themselves", "what", "which",
    "who", "whom", "this", "that", "that'll", "these", "those", "am", "is", "are",
    "was", "were", "be", "been", "being", "have", "has", "had", "having", "do",
    "does", "did", "doing", "a", "an", "the", "and", "but", "if", "or", "because",
    "as", "until", "while", "of", "at", "by", "for", "with", "about", "against",
    "between", "into", "through", "during", "before", "after", "above", "below",
    "to", "from", "up", "down", "in", "out", "on", "off", "over", "under", "again",
    "further", "then", "once", "here", "there", "when", "where", "why", "how", "all",
    "any", "both", "each", "few", "more", "most", "other", "some", "such", "no",
    "nor", "not", "only", "own", "same", "so", "than", "too", "very", "s", "t",
    "can", "will", "just", "don", "don't", "should", "should've", "now", "d", "ll",
    "m", "o", "re", "ve", "y", "ain", "aren", "aren't", "couldn", "couldn't",
    "didn", "didn't", "doesn", "doesn't", "hadn", "hadn't", "hasn", "hasn't",
    "haven", "haven't", "isn", "isn't", "ma", "mightn", "mightn't", "mustn",
    "mustn't", "needn", "needn't", "shan", "shan't", "shouldn", "shouldn't", "wasn",
    "wasn't", "weren", "weren't", "won", "won't", "wouldn", "wouldn't",
]

# ---------------------------------------------------------------------------
# FIXED VALUES: the three header-less word lists of the original system
# (acronyms: term padded to 30 chars, acronym; forced entities; entity stop
# list), in their original order.
# ---------------------------------------------------------------------------
ACRONYMS_CSV = """\
API Manager                   ,APIM
App Manager                   ,AppM
Application Server            ,AS
Business Activity Monitor     ,BAM
Business Process Server       ,BPS
Business Rules Server         ,BRS
Complex Event Processor       ,CEP
Cloud Gateway                 ,CG
Data Analytics Server         ,DAS
Data Services Server          ,DSS
Enterprise Integrator         ,EI
Enterprise Mobility Management,EMM
Enterprise Store              ,ES
Enterprise Service Bus        ,ESB
Governance Registry           ,GREG
Identity Server               ,IS
Message Broker                ,MB
Machine Learner               ,ML
Micro Services Server         ,MSS
Platform as a Service         ,PAAS
Private PAAS                  ,PPAAS
User Engagement Server        ,UES
administrator                 ,admin
administrative                ,admin
administration                ,admin
"""

ENTITY_FORCED_CSV = """\
sendmediator
2leggedoauth
3leggedoauth
action
activedirectory
activemq
address endpoint
wsdl endpoint
failover endpoint
default endpoint failover group
address endpoint url
"""

ENTITY_STOPWORDS_CSV = """\
abnormal
above
actual
action
adding
addition
additional
advanced
also
always
below
other
multiple
etc
a
an
the
"""


def _csv_rows(text: str) -> list[list[str]]:
    return [[cell.strip() for cell in line.split(",")] for line in text.splitlines() if line.strip()]


ACRONYMS = [(r[0], r[1]) for r in _csv_rows(ACRONYMS_CSV)]
ENTITY_FORCED = [r[0] for r in _csv_rows(ENTITY_FORCED_CSV)]
ENTITY_STOPWORDS = [r[0] for r in _csv_rows(ENTITY_STOPWORDS_CSV)]

# ---------------------------------------------------------------------------
# Default tagger lexicon (own content, small): form -> Penn Treebank tag.
# Forms missing here are tagged by the shape and suffix rules in
# ``kbspark.functions.tagging``. Users can pass a larger lexicon table.
# ---------------------------------------------------------------------------
_TAGS = {
    "DT": "the a an this that these those every each some any no another either neither all both half",
    "IN": ("of in on at by for with from into onto about over under between through during before after "
           "above below against among without within via per upon across since until because if as than "
           "like whether although though unless while except beside besides toward towards despite around "
           "behind beyond along inside outside near throughout"),
    "TO": "to",
    "CC": "and or but nor yet plus",
    "PRP": "i you he she it we they me him us them itself themselves yourself myself himself herself ourselves",
    "PRP$": "my your his its our their her",
    "WDT": "which whatever whichever",
    "WP": "what who whom whoever",
    "WP$": "whose",
    "WRB": "when where why how whenever wherever",
    "MD": "can could will would shall should may might must cannot",
    "VBZ": "is has does",
    "VBP": "are have do am",
    "VBD": "was were had did",
    "VB": ("be use create add run get set make see configure install enable disable start stop open select click "
           "define provide allow need want deploy build send receive change update delete remove access connect "
           "follow specify ensure check"),
    "VBN": "been done made given taken seen known shown built sent",
    "VBG": "being having doing",
    "RB": ("not also very too only just then now often always never however so already still even again "
           "here quickly usually really almost soon later once"),
    "EX": "there",
    "JJ": ("new old good bad first last other same different many few several such own main important available "
           "simple default common large small high low next previous full secure public private free open "
           "possible able"),
    "JJR": "more less better larger smaller higher lower worse",
    "JJS": "most least best largest smallest highest lowest worst",
    "CD": "one two three four five six seven eight nine ten hundred thousand million zero",
    "UH": "yes oh",
    "RP": "off",
    "POS": "'s",
}

# form -> tag; a form listed under several tags keeps the first listing above.
LEXICON_TAGS: dict[str, str] = {}
for _tag, _forms in _TAGS.items():
    for _form in _forms.split():
        LEXICON_TAGS.setdefault(_form, _tag)

# (form, WordNet class) -> lemma; own irregular forms only. Regular forms
# lemmatise to themselves, as an unknown word does.
LEMMAS: dict[tuple[str, str], str] = {
    ("is", "v"): "be", ("are", "v"): "be", ("was", "v"): "be", ("were", "v"): "be",
    ("been", "v"): "be", ("being", "v"): "be", ("am", "v"): "be",
    ("has", "v"): "have", ("had", "v"): "have", ("having", "v"): "have",
    ("does", "v"): "do", ("did", "v"): "do", ("done", "v"): "do", ("doing", "v"): "do",
    ("made", "v"): "make", ("making", "v"): "make", ("ran", "v"): "run", ("running", "v"): "run",
    ("got", "v"): "get", ("given", "v"): "give", ("gave", "v"): "give", ("taken", "v"): "take",
    ("took", "v"): "take", ("seen", "v"): "see", ("saw", "v"): "see", ("known", "v"): "know",
    ("knew", "v"): "know", ("shown", "v"): "show", ("built", "v"): "build", ("sent", "v"): "send",
    ("uses", "v"): "use", ("used", "v"): "use", ("using", "v"): "use",
    ("children", "n"): "child", ("men", "n"): "man", ("women", "n"): "woman", ("mice", "n"): "mouse",
    ("feet", "n"): "foot", ("teeth", "n"): "tooth", ("geese", "n"): "goose", ("indice", "n"): "index",
    ("analyse", "n"): "analysis", ("criteria", "n"): "criterion", ("phenomena", "n"): "phenomenon",
    ("better", "a"): "good", ("best", "a"): "good", ("worse", "a"): "bad", ("worst", "a"): "bad",
}

# ---------------------------------------------------------------------------
# Default lexical units (own content, small): unit name "words.class" -> frame.
# ---------------------------------------------------------------------------
LEXICAL_UNITS: list[tuple[str, str]] = [
    ("use.v", "Using"), ("use.n", "Using"), ("run.v", "Operating_a_system"), ("run.v", "Self_motion"),
    ("start.v", "Activity_start"), ("stop.v", "Activity_stop"), ("create.v", "Creating"),
    ("set up.v", "Creating"), ("add.v", "Cause_to_be_included"), ("install.v", "Installing"),
    ("configure.v", "Adjusting"), ("send.v", "Sending"), ("receive.v", "Receiving"),
    ("message.n", "Communication"), ("take off.v", "Removing"), ("delete.v", "Removing"),
    ("remove.v", "Removing"), ("give up.v", "Quitting"), ("a lot.n", "Quantity"),
    ("first.a", "Ordinal_numbers"), ("last.a", "Ordinal_numbers"), ("new.a", "Age"), ("old.a", "Age"),
    ("quickly.adv", "Speed_description"), ("fast.a", "Speed_description"), ("one.num", "Cardinal_numbers"),
    ("access.v", "Having_or_lacking_access"), ("access.n", "Having_or_lacking_access"),
    ("error.n", "Correctness"), ("change.v", "Cause_change"), ("update.v", "Updating"),
    ("open.v", "Opening"), ("open.a", "Openness"), ("key.n", "Key"), ("file.n", "Documents"),
    ("server.n", "Computing_device"), ("user.n", "Using"), ("make.v", "Manufacturing"),
    ("make.v", "Causation"), ("have.v", "Possession"), ("be.v", "Existence"), ("see.v", "Perception_experience"),
    ("get.v", "Getting"), ("need.v", "Needing"), ("want.v", "Desiring"), ("build.v", "Building"),
    ("good.a", "Desirability"), ("bad.a", "Desirability"), ("large.a", "Size"), ("small.a", "Size"),
    ("time.n", "Measure_duration"), ("day.n", "Calendric_unit"), ("year.n", "Calendric_unit"),
    ("word.n", "Simple_name"), ("name.n", "Being_named"), ("name.v", "Name_conferral"),
    ("work.v", "Work"), ("work.n", "Work"), ("write.v", "Text_creation"), ("read.v", "Reading_activity"),
    ("high.a", "Position_on_a_scale"), ("low.a", "Position_on_a_scale"), ("come.v", "Arriving"),
    ("go.v", "Motion"), ("say.v", "Statement"), ("find.v", "Locating"), ("give.v", "Giving"),
    ("take.v", "Taking"), ("know.v", "Awareness"), ("think.v", "Opinion"), ("show.v", "Evidence"),
]
