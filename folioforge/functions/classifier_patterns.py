"""The classifiers' patterns, in the order in which they are tried."""

# Fixed values.
PAGE = [
    r"(\d+)\s+pages?\s+for\s+(?:the\s+)?main\s+(?:content|paper|text)?,?\s+plus\s+unlimited\s+(?:pages?\s+(?:for\s+)?)?references?(?:\s+and\s+(?:unlimited\s+)?appendices)?",
    r"(\d+)\s+pages?\s+for\s+(?:main|content)(?:\s+(?:paper|text))?,?\s+plus\s+unlimited\s+references",
    r"(\d+)\s+pages?\s+(?:plus|\+)\s+unlimited\s+(?:pages?\s+(?:for\s+)?)?references?",
    r"(\d+)\s+pages?\s+(?:excluding|not\s+including)\s+references?(?:\s+and\s+appendices)?",
    r"(\d+)\s+pages?(?:,|\s+(?:and|where|with))?\s+references?\s+(?:do\s+)?not\s+count",
    r"(\d+)\s+pages?\s+plus\s+(?:up\s+to\s+)?(\d+)\s+pages?\s+(?:for\s+|of\s+)?(?:references?|appendices)",
    r"(\d+)\s+pages?\s+\((?:references?\s+)?(?:excluded|not\s+included|excluding\s+references?)\)",
    r"maximum\s+(?:of\s+)?(\d+)\s+pages?",
    r"limited\s+to\s+(?:a\s+maximum\s+(?:of\s+)?)?(\d+)\s+pages?",
    r"(?:up\s+to|at\s+most)\s+(\d+)\s+pages?",
    r"(\d+)[- ]page\s+(?:limit|maximum)",
    r"page\s+limit\s+(?:is\s+)?(\d+)\s+pages?",
    r"papers?\s+(?:must|should)\s+be\s+(\d+)\s+pages?",
    r"(?:must\s+|should\s+)?not\s+exceed\s+(\d+)\s+pages?",
    r"no\s+(?:longer|more)\s+than\s+(\d+)\s+pages?",
    r"submissions?\s+(?:are\s+)?limited\s+to\s+(\d+)\s+pages?",
    r"manuscripts?\s+(?:of\s+)?up\s+to\s+(\d+)\s+pages?",
    r"between\s+(\d+)\s+and\s+(\d+)\s+pages?",
    r"(\d+)\s*(?:-|to)\s*(\d+)\s+pages?",
    r"(?i)Long\s+Papers?\s+\((\d+)\s+pages?\)\s+and\s+Short\s+Papers?\s+\((\d+)\s+pages?\)",
    r"(?i)(?:long|full|research|regular)\s+papers?\s*[:(]\s*(\d+)\s+pages?\s*[)]?",
    r"(?i)(?:short|extended\s+abstract)\s+papers?\s*[:(]\s*(\d+)\s+pages?\s*[)]?",
    r"(?i)limited\s+to\s+(one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve)\s+(?:content\s+)?pages?",
    r"(?i)(one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve)\s+(?:content\s+)?pages?\s+for\s+(?:the\s+)?main",
    r"(?i)(one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve)\s+pages?\s+(?:of\s+)?content",
    r"(?i)(?:main\s+text\s+)?must\s+be\s+between\s+(\d+)\s+and\s+(\d+)\s+pages?",
    r"(?i)limited\s+to\s+(\d+)\s+content\s+pages?",
    r"(?i)beyond\s+the\s+first\s+(\d+)\s+pages?",
    r"(?i)(?:the\s+)?first\s+(\d+)\s+pages?(?:\s+(?:should|must|will))",
]

# What a page limit's own words exclude.
OWN_REFERENCES = r"unlimited\s+(?:pages?\s+(?:for\s+)?)?references?|exclud(?:ing|ed)\s+references?|not\s+counting\s+references?|references?\s+(?:do\s+)?not\s+count|references?\s+(?:excluded|not\s+included)"
OWN_APPENDICES = r"unlimited\s+(?:pages?\s+(?:for\s+)?)?appendices|exclud(?:ing|ed)\s+(?:appendices|appendix)|not\s+counting\s+(?:appendices|appendix)|appendices?\s+(?:do\s+)?not\s+count"
OWN_BOUND = r"plus\s+(?:up\s+to\s+)?(\d+)\s+pages?\s+(?:for\s+|of\s+)?(references?|appendices)"

# Fixed values.
EXCLUSIONS = {
    'references': [
        r"unlimited\s+(?:pages?\s+(?:for\s+)?)?(?:references?|bibliograph(?:y|ies))",
        r"(?:plus|with)\s+unlimited\s+(?:pages?\s+(?:for\s+)?)?(?:references?|bibliograph(?:y|ies))",
        r"(?:(?:the|a)\s+)?(?:list\s+of\s+)?(?:references?|bibliograph(?:y|ies))\s+(?:do(?:es)?\s+)?not\s+count(?:\s+toward(?:s)?(?:\s+(?:the|this))?(?:\s+page)?\s+limit)?",
        r"(?:the\s+)?(?:list\s+of\s+)?(?:references?|bibliograph(?:y|ies))\s+(?:is|are)\s+not\s+included\s+in\s+(?:the\s+)?(?:\d+[- ])?page\s+(?:limit|count)",
        r"exclud(?:ing|ed?)\s+(?:the\s+)?(?:list\s+of\s+)?(?:references?|bibliograph(?:y|ies))",
        r"not\s+includ(?:ing|e|ed)\s+(?:the\s+)?(?:list\s+of\s+)?(?:references?|bibliograph(?:y|ies))",
        r"not\s+counting\s+(?:the\s+)?(?:list\s+of\s+)?(?:references?|bibliograph(?:y|ies))",
        r"(?:page\s+)?limit\s+(?:does\s+)?not\s+include\s+(?:the\s+)?references?",
        r"no\s+(?:page\s+)?limit\s+(?:on|for)\s+(?:the\s+)?references?",
        r"references?\s+(?:are\s+)?(?:listed\s+)?separate(?:ly)?",
        r"(?:in\s+)?addition\s+to\s+(?:the\s+)?(?:\d+[- ])?page\s+limit.*?references?",
        r"plus\s+(?:up\s+to\s+)?(\d+)\s+pages?\s+(?:for\s+|of\s+)?references?",
    ],
    'appendices': [
        r"appendices?\s+(?:do\s+)?not\s+count(?:\s+toward)?",
        r"unlimited\s+(?:pages?\s+(?:for\s+)?)?(?:appendices|appendix)",
        r"exclud(?:ing|ed)\s+(?:the\s+)?(?:appendices|appendix)",
        r"not\s+includ(?:ing|ed)\s+(?:the\s+)?(?:appendices|appendix)",
        r"not\s+counting\s+(?:the\s+)?(?:appendices|appendix)",
        r"(?:appendices|appendix)\s+(?:is\s+|are\s+)?(?:beyond|outside)\s+(?:the\s+)?page\s+limit",
        r"plus\s+(?:up\s+to\s+)?(\d+)\s+pages?\s+(?:for\s+|of\s+)?(?:appendices|appendix)",
    ],
    'acknowledgments': [
        r"acknowledgments?\s+(?:do(?:es)?\s+)?not\s+count",
    ],
    'ethics_statement': [
        r"ethics\s+(?:statement|section)\s+(?:does\s+)?not\s+count",
    ],
    'impact_statement': [
        r"(?:broader\s+)?impact\s+statement\s+(?:does\s+)?not\s+count",
    ],
}

# Fixed values.
REVIEW = {
    'double_blind': [
        r"double[- ]blind",
        r"anonymized?\s+(?:submission|review|manuscript|paper)",
        r"(?:submissions?|papers?)\s+(?:must|should|will)\s+be\s+anonymous(?:ized)?",
        r"(?:submitted|submit)\s+(?:papers?|manuscripts?)\s+(?:must|should)\s+be\s+anonymous",
        r"remove\s+(?:all\s+)?author\s+(?:names?|identif(?:ying|ication)|information)",
        r"both\s+(?:reviewers?\s+and\s+authors?|authors?\s+and\s+reviewers?)\s+(?:are\s+)?anonymous",
        r"authors?\s+(?:and\s+)?reviewers?\s+(?:are\s+)?(?:both\s+)?anonymous",
        r"blind\s+(?:to|submission).*author",
        r"author\s+identit(?:y|ies)\s+(?:must\s+)?(?:be\s+)?(?:hidden|concealed)",
    ],
    'single_blind': [
        r"single[- ]blind",
        r"reviewers?\s+(?:are|remain|will\s+be)\s+anonymous",
        r"authors?\s+(?:are\s+)?(?:known|visible).*reviewers?\s+(?:are\s+)?anonymous",
        r"reviewer\s+anonymity\s+(?:is\s+)?maintained",
        r"reviews?\s+(?:are\s+)?anonymous.*authors?\s+(?:are\s+)?(?:known|visible)",
    ],
    'open_review': [
        r"open\s+(?:peer\s+)?review(?:\s+process)?",
        r"reviews?\s+(?:will\s+be|are)\s+(?:made\s+)?public(?:ly)?(?:\s+available)?",
        r"transparent\s+review(?:\s+process)?",
        r"public\s+(?:review|discussion)",
        r"reviews?\s+(?:and\s+)?(?:author\s+)?responses?\s+(?:will\s+be\s+)?(?:made\s+)?public",
        r"non[- ]anonymous\s+review",
    ],
}

# Fixed values.
REBUTTAL = {
    'allowed': [
        r"author(?:s)?\s+(?:may|can|will\s+have)\s+(?:the\s+)?(?:opportunity\s+)?(?:to\s+)?(?:submit\s+)?rebuttals?",
        r"rebuttals?\s+(?:are\s+)?(?:allowed|permitted|encouraged)",
        r"(?:will\s+have|have)\s+(?:the\s+)?(?:opportunity|chance)\s+to\s+respond\s+to\s+reviews?",
        r"author\s+response\s+(?:period|phase)",
        r"response\s+to\s+reviewers?",
    ],
    'not_allowed': [
        r"no\s+rebuttals?",
        r"rebuttals?\s+(?:are\s+)?not\s+(?:allowed|permitted)",
        r"(?:will\s+)?not\s+(?:be\s+)?(?:able|allowed)\s+to\s+submit\s+rebuttals?",
    ],
}

# Fixed values.
DESK_REJECTION = {
    'yes': [
        r"desk\s+reject(?:ion)?",
        r"papers?\s+may\s+be\s+desk\s+rejected",
        r"(?:may|will)\s+be\s+rejected\s+without\s+(?:full\s+)?review",
        r"administrative\s+reject(?:ion)?",
    ],
    'no': [
        r"no\s+desk\s+reject(?:ion)?",
        r"all\s+papers?\s+(?:will\s+)?(?:be\s+)?(?:fully\s+)?reviewed",
    ],
}

# Fixed values.
RECIPROCAL = {
    True: [
        r"reciprocal\s+review(?:ing)?",
        r"(?:must|required\s+to)\s+review\s+other\s+(?:papers?|submissions?)",
        r"authors?\s+(?:are\s+)?(?:expected|required)\s+to\s+(?:serve\s+as\s+)?reviewers?",
    ],
    False: [
        r"no\s+reciprocal\s+review",
        r"(?:not\s+)?required\s+to\s+review",
    ],
}

# Fixed values.
POLICIES = {
    'artifact_evaluation': {
        'mandatory': [
            r"artifacts?\s+(?:submission\s+)?(?:is\s+)?(?:required|mandatory)",
            r"(?:are\s+)?required\s+to\s+submit\s+artifacts?",
            r"code\s+submission\s+(?:is\s+)?required",
            r"must\s+(?:submit|provide|include)\s+(?:code|artifacts?|data)",
            r"all\s+papers?\s+must\s+include\s+(?:code|artifacts?)",
        ],
        'optional': [
            r"(?:may\s+)?optionally\s+submit\s+artifacts?",
            r"artifacts?\s+(?:are\s+)?optional",
            r"artifact\s+submission\s+is\s+(?:voluntary|optional)",
            r"submit\s+code\s+for\s+artifact",
            r"(?:strongly\s+)?(?:encouraged|recommended)\s+(?:to\s+)?(?:submit|provide)\s+(?:code|artifacts?)",
            r"artifact\s+evaluation\s+is\s+(?:encouraged|recommended)",
            r"(?:we\s+)?encourage\s+(?:authors?\s+)?to\s+submit\s+artifacts?",
            r"(?:encouraged|recommended)\s+to\s+submit.*?(?:data|source\s+code|supplementary\s+material)",
            r"(?:encouraged|recommended)\s+to\s+(?:provide|upload).*?(?:data|code)",
        ],
        'not_mentioned': [],
    },
    'llm_policy': {
        'required_disclosure': [
            r"(?:may|can)\s+use\s+(?:large\s+language\s+models?|LLMs?|AI|ChatGPT)(?:.*?)must\s+disclose",
            r"(?:use|usage)\s+of\s+(?:large\s+language\s+models?|LLMs?|AI)\s+(?:is\s+)?allowed(?:.*?)disclose",
            r"disclose\s+(?:any\s+)?(?:use|usage)\s+of\s+(?:LLMs?|AI|ChatGPT|large\s+language\s+models?)",
        ],
        'forbidden': [
            r"(?:use\s+of\s+)?(?:AI-generated|LLM-generated)\s+(?:text|content)\s+(?:is\s+)?prohibited",
            r"(?:LLMs?|AI|ChatGPT)(?:.*?)(?:is\s+)?(?:prohibited|not\s+allowed|forbidden)",
            r"(?:do\s+not|cannot)\s+use\s+(?:LLMs?|AI|ChatGPT)",
            r"papers?\s+found\s+to\s+contain\s+(?:ChatGPT|LLM|AI)",
            r"discourage\s+(?:the\s+)?use\s+of\s+(?:large\s+language\s+models?|LLMs?|AI)",
            r"(?:LLMs?|AI)\s+(?:usage\s+)?(?:is\s+)?discouraged",
            r"(?:should|recommend)\s+not\s+use\s+(?:LLMs?|AI)",
        ],
        'allowed': [
            r"(?:may|can)\s+use\s+(?:large\s+language\s+models?|LLMs?|AI|ChatGPT)",
            r"(?:LLMs?|AI)\s+(?:usage\s+)?(?:is\s+)?(?:allowed|permitted)",
        ],
        'not_mentioned': [],
    },
    'concurrent_submission': {
        'not_allowed': [
            r"concurrent\s+submissions?\s+(?:are\s+)?(?:not\s+)?(?:allowed|permitted|prohibited)",
            r"papers?\s+under\s+review\s+at\s+other\s+venues\s+will\s+be\s+rejected",
            r"simultaneous\s+submission(?:s)?\s+(?:to\s+)?(?:multiple\s+)?(?:conferences?\s+)?(?:is\s+)?not\s+permitted",
            r"(?:do\s+not|cannot)\s+submit\s+(?:concurrently|simultaneously)",
        ],
        'allowed': [
            r"(?:may|can)\s+submit(?:.*?)concurrently",
            r"concurrent\s+submissions?\s+(?:are\s+)?(?:allowed|permitted)",
            r"parallel\s+submissions?\s+(?:are\s+)?permitted",
            r"authors?\s+may\s+submit(?:.*?)(?:to\s+)?other\s+venues",
        ],
        'not_mentioned': [],
    },
    'arxiv_preprint': {
        'allowed': [
            r"arXiv\s+(?:preprints?\s+)?(?:are\s+)?allowed",
            r"(?:may|can)\s+(?:post|upload)\s+(?:to\s+)?arXiv",
        ],
        'not_allowed': [
            r"arXiv\s+(?:preprints?\s+)?(?:are\s+)?(?:not\s+)?(?:allowed|permitted|prohibited)",
            r"(?:do\s+not|cannot)\s+(?:post|upload)\s+(?:to\s+)?arXiv",
        ],
        'not_mentioned': [],
    },
}

# Fixed values.
STATEMENTS = {
    'ethics_statement': [
        r"ethics\s+statement\s+(?:is\s+)?(?:required|mandatory)",
        r"must\s+include\s+(?:an?\s+)?ethics\s+statement",
        r"ethics\s+section\s+(?:is\s+)?required",
        r"-\s+ethics\s+statement",
        r"(?:all\s+)?papers?\s+must\s+include\s+(?:an?\s+)?ethics\s+statement",
    ],
    'broader_impact': [
        r"broader\s+impacts?\s+(?:statement|section)\s+(?:is\s+)?required",
        r"impact\s+statement\s+(?:is\s+)?required",
        r"must\s+include\s+(?:an?\s+)?(?:broader\s+)?impacts?\s+(?:statement|section)",
        r"-\s+broader\s+impact",
        r"discuss\s+(?:the\s+)?broader\s+impacts?(?:.*?)required",
        r"dedicated\s+impact\s+statement(?:.*?)required",
        r"societal\s+impact",
    ],
    'reproducibility_checklist': [
        r"reproducibility\s+checklist\s+(?:is\s+)?(?:required|mandatory)",
        r"must\s+complete\s+(?:the\s+)?reproducibility\s+checklist",
        r"checklist\s+(?:is\s+)?(?:required|mandatory)",
        r"-\s+reproducibility\s+checklist",
        r"(?:required|must)\s+(?:to\s+)?complete\s+(?:a\s+)?(?:paper\s+)?checklist",
        r"(?:authors?\s+(?:are\s+)?)?required\s+to\s+complete\s+(?:a\s+)?(?:paper\s+)?checklist",
        r"checklist\s+forms\s+part\s+of\s+(?:the\s+)?(?:paper\s+)?submission",
        r"paper\s+checklist",
        r"NeurIPS\s+(?:paper\s+)?checklist",
    ],
    'limitations_section': [
        r"limitations\s+section\s+(?:is\s+)?required",
        r"must\s+include\s+(?:a\s+)?limitations\s+(?:section|discussion)",
    ],
    'funding_disclosure': [
        r"funding\s+disclosure\s+(?:is\s+)?required",
        r"must\s+disclose\s+funding",
        r"conflict\s+of\s+interest\s+(?:statement\s+)?(?:is\s+)?required",
    ],
}

# Fixed values.
TEMPLATE = {
    'required': [
        r"(?:must|required\s+to)\s+use\s+(?:the\s+)?(?:provided\s+)?(?:LaTeX|Word|conference)\s+template",
        r"template\s+(?:is\s+)?(?:required|mandatory)",
        r"(?:papers?|submissions?)\s+must\s+(?:be\s+)?(?:formatted\s+)?using\s+(?:the\s+)?template",
        r"(?:LaTeX|Word)\s+template\s+(?:is\s+)?(?:required|mandatory)",
    ],
    'optional': [
        r"template\s+(?:is\s+)?(?:available|provided|optional)",
        r"(?:may|can)\s+use\s+(?:the\s+)?template",
    ],
}

# Fixed values.
SUPPLEMENTARY = {
    'allowed': [
        r"supplementary\s+(?:materials?|files?)\s+(?:are\s+)?(?:allowed|permitted|encouraged)",
        r"(?:may|can)\s+(?:include|submit|provide)\s+supplementary\s+(?:materials?|files?)",
        r"appendices?\s+(?:are\s+)?(?:allowed|permitted)",
        r"additional\s+materials?\s+(?:may|can)\s+be\s+(?:submitted|included)",
    ],
    'not_allowed': [
        r"no\s+supplementary\s+(?:materials?|files?)",
        r"supplementary\s+(?:materials?|files?)\s+(?:are\s+)?not\s+(?:allowed|permitted)",
    ],
}

# Fixed values.
PRESENTATION = [
    r"(?:oral|poster|demo|virtual|in-person|hybrid)\s+presentations?",
    r"presented\s+as\s+(?:oral|poster|demo)",
    r"(?:will\s+be\s+)?presented\s+(?:orally|as\s+posters?|virtually)",
]

# Fixed values.
DELIVERY = {
    'in-person': [
        r"in[- ]person\s+(?:conference|event|meeting)",
        r"physical\s+conference",
        r"on[- ]site\s+(?:conference|event)",
    ],
    'virtual': [
        r"virtual\s+(?:conference|event|meeting)",
        r"online\s+(?:conference|event|meeting)",
        r"remote\s+(?:conference|participation)",
    ],
    'hybrid': [
        r"hybrid\s+(?:conference|event|meeting)",
        r"(?:virtual|online)\s+and\s+(?:in[- ]person|physical)",
        r"(?:in[- ]person|physical)\s+and\s+(?:virtual|online)",
    ],
}

# Fixed values.
AID = [
    r"(?:financial\s+)?(?:aid|assistance|support)\s+(?:is\s+)?available",
    r"(?:travel\s+)?grants?\s+(?:are\s+)?available",
    r"(?:student\s+)?scholarships?\s+(?:are\s+)?available",
    r"funding\s+(?:is\s+)?available",
]

# Fixed values.
WORKSHOPS = [
    r"workshops?(?:\s+and\s+tutorials?)?",
    r"co[- ]located\s+workshops?",
    r"affiliated\s+workshops?",
]

# Fixed values.
TRACKS = {
    'has_workshop_proposals': [
        r"call\s+for\s+workshop\s+proposals?",
        r"workshop\s+proposals?\s+(?:are\s+)?(?:invited|solicited|welcome)",
        r"submit\s+(?:a\s+)?workshop\s+proposal",
        r"proposing\s+(?:a\s+)?workshop",
    ],
    'has_tutorials': [
        r"call\s+for\s+tutorials?",
        r"tutorial\s+(?:track|proposals?|submissions?|program)",
        r"tutorials?\s+(?:are\s+)?(?:invited|solicited|welcome)",
        r"(?:include|offer|feature)s?\s+tutorials?",
    ],
    'has_demos': [
        r"call\s+for\s+demos?",
        r"(?:system\s+)?demonstrations?\s+(?:track|papers?|submissions?)",
        r"demo\s+(?:track|papers?|submissions?|program)",
        r"system\s+demonstrations?",
    ],
    'has_posters': [
        r"call\s+for\s+posters?",
        r"poster\s+(?:track|session|submissions?|program)",
        r"(?:submit|present)\s+(?:a\s+)?poster",
    ],
    'has_industry_track': [
        r"industry\s+(?:track|papers?|program|session)",
        r"(?:applied|applications?)\s+(?:track|papers?|program)",
        r"call\s+for\s+industry",
    ],
    'has_position_papers': [
        r"position\s+papers?",
        r"opinion\s+papers?",
        r"perspective\s+papers?",
        r"call\s+for\s+position",
    ],
    'has_student_research': [
        r"student\s+research\s+(?:workshop|competition|forum|track)",
        r"SRW\b",
        r"student\s+abstract",
        r"(?:undergraduate|graduate)\s+(?:student\s+)?research\s+(?:track|forum)",
    ],
    'has_doctoral_consortium': [
        r"doctoral\s+(?:consortium|symposium|forum)",
        r"DC\s+(?:track|program|submissions?)",
        r"call\s+for\s+doctoral\s+consortium",
    ],
    'has_findings': [
        r"\bfindings\b\s+(?:track|papers?|of\s+(?:ACL|EMNLP|NAACL|EACL))",
        r"findings\s+(?:submissions?|program)",
        r"(?:accepted|published)\s+(?:in|to)\s+findings",
    ],
    'has_awards': [
        r"best\s+paper\s+award",
        r"outstanding\s+paper\s+award",
        r"distinguished\s+paper\s+award",
        r"test[- ]of[- ]time\s+award",
        r"best\s+(?:student\s+)?paper",
    ],
}
