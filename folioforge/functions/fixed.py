"""Word lists, weights and lookup tables that results depend on."""

# Hosts that are never a homepage (substring of the host).
EXCLUDED_DOMAINS = [
    "wikicfp.com", "wikipedia.org", "paperswithcode.com", "conferencelist.info", "medium.com", "reddit.com", "twitter.com", "facebook.com",
    "mlscientist.com", "aclanthology.org", "openreview.net", "aideadlines.org", "journalsearches.com", "swoogo.com", "grokipedia.com",
]
# Address endings, hosts and path parts of pages that aren't read.
SKIP_EXTENSIONS = [
    ".pdf", ".doc", ".docx", ".txt", ".rtf", ".zip", ".tar", ".gz", ".rar", ".7z", ".ppt", ".pptx", ".xls", ".xlsx", ".mp3", ".mp4", ".wav", ".avi",
    ".mov", ".exe", ".dmg", ".pkg", ".jpg", ".jpeg", ".png", ".gif", ".svg",
]
SKIP_HOSTS = ["arxiv.org", "researchgate.net", "scholar.google"]
SKIP_PATHS = [
    "accepted-papers", "accepted_papers", "acceptedpapers", "technical-sessions", "technical-session", "proceedings", "program-schedule",
    "program-at-a-glance", "paper-list", "paperlist", "main-track-accepted", "accepted-abstracts", "full-program", "session-details",
]
SKIP_CONTENT_TYPES = [
    "application/pdf", "application/msword", "application/vnd.openxmlformats-officedocument", "application/zip", "application/x-rar-compressed",
    "application/gzip", "image/", "video/", "audio/",
]
# Relevance weights; every contained key counts.
URL_WEIGHTS = [
    ("call", 50), ("cfp", 60), ("submit", 45), ("submission", 40), ("contribute", 40), ("author", 35), ("paper", 30), ("deadline", 40), ("guideline", 30),
    ("instruction", 25), ("review", 20), ("abstract", 25), ("notification", 35), ("sponsor", 5), ("blog", 10), ("news", 15), ("accepted-papers", -100),
    ("accepted_papers", -100), ("acceptedpapers", -100), ("technical-sessions", -100), ("technical-session", -100), ("proceedings", -80),
    ("program-schedule", -80), ("program-at-a-glance", -70), ("paper-list", -100), ("paperlist", -100), ("main-track-accepted", -100),
    ("session-details", -80), ("registration", -50), ("venue", -40), ("hotel", -60), ("travel", -50), ("accommodation", -60), ("know-before-you-go", -40),
    ("visitor-information", -40), ("code-of-conduct", -30), ("diversity", -20), ("ethics-guidelines", -30), ("banquet", -40), ("visa", -50),
]
TEXT_WEIGHTS = [
    ("call for papers", 100), ("submission deadline", 80), ("submission due", 75), ("deadline", 50), ("important dates", 70), ("paper submission", 60),
    ("papers due", 65), ("notification", 60), ("camera ready", 50), ("abstract deadline", 50), ("conference dates", 55), ("author guidelines", 50),
    ("author instructions", 50), ("submission requirements", 50), ("page limit", 45), ("review process", 40), ("double blind", 50), ("double-blind", 50),
    ("single blind", 30), ("rebuttal", 40), ("desk reject", 35), ("ethics statement", 40), ("artifact submission", 35), ("code submission", 35),
    ("reproducibility", 30), ("submission system", 40), ("openreview", 40), ("easychair", 40), ("accommodation", -30), ("hotel information", -30),
    ("travel information", -25), ("visitor information", -25), ("student volunteer", -25), ("social event", -20), ("banquet dinner", -20),
    ("visa information", -20), ("code of conduct", -20), ("frequently asked questions", -15), ("expo", -15), ("sponsorship", -20), ("login required", 5),
]
PAPER_LIST_WEIGHTS = [("accepted papers", 2), ("technical sessions", 2), ("proceedings", 1), ("paper presentations", 2), ("session schedule", 1), ("list of keywords", 1)]
# Link words.
LINK_URL_WORDS = r"cfp|call-for|call_for|submission|deadlines?|author|guideline|important-date|camera.?ready|paper.?format|topics?-of-interest"
LINK_TEXT_WORDS = r"call for|cfp|submission|deadlines?|author|guideline|important date|camera.?ready|paper format|topics? of interest"
LINK_STRONG_WORDS = r"cfp|call.for.paper|submission|deadlines?|important.date"
# Elements without text of their own, and elements that open a line.
DROPPED_TAGS = ["script", "style", "nav", "header", "footer"]
DROPPED_TAGS_FLAT = ["script", "style", "nav", "footer", "header", "code", "pre", "kbd", "samp", "var"]
LINE_TAGS = ["p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "tr", "blockquote", "dd", "dt", "pre"]
# Months and their short forms.
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
MONTH_FORMS = [(m[:3], m) for m in MONTHS] + [("Sept", "September")]
# Number words in the order in which they are tried.
NUMBER_WORDS = ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve"]
# Words that negate.
NEGATIONS = [
    r"\bnot\b", r"\bno\b", r"\bnever\b", r"\bwithout\b", r"\bneither\b", r"\bnor\b", r"\bcannot\b", r"\bcan't\b", r"\bwon't\b", r"\bdon't\b",
    r"\bdoesn't\b", r"\bshouldn't\b", r"\bmustn't\b", r"\bforbid", r"\bprohibit", r"\bdisallow", r"\bban\b", r"\bunaccept", r"\bimpermiss",
]
NEGATIVE_NAMES = ["not_allowed", "not_permitted", "prohibited", "forbidden", "not_double_blind", "single_blind", "not_required", "may_not", "cannot", "no_", "without"]
# Places.
COUNTRIES = {
    "us": "US", "usa": "US", "usa.": "US", "u.s.a": "US", "u.s.a.": "US", "u.s.": "US", "united states": "US", "united states of america": "US",
    "florida usa": "US", "south carolina usa": "US", "uk": "UK", "u.k.": "UK", "united kingdom": "UK", "united kindom": "UK", "england": "UK",
    "scotland": "UK", "wales": "UK", "northern ireland": "UK", "uae": "UAE", "u.a.e": "UAE", "u.a.e.": "UAE", "united arab emirates": "UAE",
    "china": "China", "p.r. china": "China", "taiwan": "Taiwan, China", "hong kong": "Hong Kong, China", "hong kong sar": "Hong Kong, China",
    "macao": "Macao, China", "macau": "Macao, China", "macao sar": "Macao, China", "macau sar": "Macao, China", "korea": "South Korea",
    "s.korea": "South Korea", "s. korea": "South Korea", "republic of korea": "South Korea", "south korea": "South Korea", "south korea.": "South Korea",
    "canada": "Canada", "canada.": "Canada", "vancouver bc canada": "Canada", "mexico": "Mexico", "méxico": "Mexico", "czech republic": "Czech Republic",
    "czechia": "Czech Republic", "turkey": "Turkey", "türkiye": "Turkey", "türki̇ye": "Turkey", "curaçao": "Curacao", "curacao": "Curacao",
    "home of robin hood": "UK", "minato city": "Japan",
}
US_STATES = (
    "alabama,alaska,arizona,arkansas,california,colorado,connecticut,delaware,florida,georgia,hawaii,idaho,illinois,indiana,iowa,kansas,kentucky,louisiana,maine,maryland,massachusetts,michigan,"
    "minnesota,mississippi,missouri,montana,nebraska,nevada,new hampshire,new jersey,new mexico,new york,north carolina,north dakota,ohio,oklahoma,oregon,pennsylvania,rhode island,south carolina,"
    "south dakota,tennessee,texas,utah,vermont,virginia,washington,west virginia,wisconsin,wyoming,district of columbia,dc"
).split(",")
US_STATE_CODES = "al ak az ar ca co ct de fl ga hi id il in ia ks ky la me md ma mi mn ms mo mt ne nv nh nj nm ny nc nd oh ok or pa ri sc sd tn tx ut vt va wa wv wi wy dc".split()
CITY_STATES = ["singapore", "monaco", "vatican city"]
TERRITORIES = ["hong kong", "hong kong sar", "taiwan", "macao", "macau", "macau sar", "macao sar"]
TERRITORY_NAMES = {"hong kong sar": "hong kong", "macau sar": "macau", "macao sar": "macao"}
VENUE_WORDS = [
    "centre", "center", "convention", "hotel", "resort", "spa", "university", "palace", "exhibition", "congress", "marriott", "hilton", "sheraton", "hyatt",
    "westin", "conference", "school", "campus", "building", "hall", "complex",
]
KNOWN_COUNTRIES = (
    "afghanistan albania algeria andorra angola argentina armenia australia austria azerbaijan bahamas bahrain bangladesh barbados belarus belgium belize benin bhutan bolivia bosnia botswana brazil "
    "brunei bulgaria burkina burundi cambodia cameroon canada cape central chad chile china colombia comoros congo costa croatia cuba cyprus czechia denmark djibouti dominica dominican ecuador egypt "
    "estonia ethiopia fiji finland france gabon gambia georgia germany ghana greece grenada guatemala guinea guyana haiti honduras hungary iceland india indonesia iran iraq ireland israel italy jamaica "
    "japan jordan kazakhstan kenya kiribati korea kosovo kuwait kyrgyzstan laos latvia lebanon lesotho liberia libya liechtenstein lithuania luxembourg madagascar malawi malaysia maldives mali malta "
    "marshall mauritania mauritius mexico micronesia moldova monaco mongolia montenegro morocco mozambique myanmar namibia nauru nepal netherlands nicaragua niger nigeria norway oman pakistan palau "
    "palestine panama papua paraguay peru philippines poland portugal qatar romania russia rwanda samoa san saudi senegal serbia seychelles sierra slovakia slovenia solomon somalia south spain sri sudan "
    "suriname sweden switzerland syria taiwan tajikistan tanzania thailand timor togo tonga trinidad tunisia turkey turkmenistan tuvalu uganda ukraine uruguay uzbekistan vanuatu vatican venezuela "
    "vietnam yemen zambia zimbabwe"
).split()
CORRUPTION_WORDS = ["viewed", "backdrop", "acronyms", "against this", "instance", "between", "authors", "for", "they", "the", "virtual", "online", "hybrid"]
DAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
# How much a field counts when rules are ordered for display.
IMPORTANCE = {
    "page_limit": 10, "submission_deadline": 10, "double_blind": 9, "rebuttal_allowed": 8, "concurrent_submission": 8, "arxiv_preprint": 8,
    "desk_rejection": 8, "llm_policy": 7, "notification_date": 6, "conference_location": 6, "single_blind": 2, "has_tutorials": 1,
}
