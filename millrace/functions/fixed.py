"""Word lists, patterns and tables that the results depend on. Patterns are written for Java."""

STOP_WORDS_RULES = ["what", "is", "the", "and", "or", "of", "to", "in", "a", "for", "with", "on", "at", "by", "from", "under", "across", "vs", "versus", "compare", "does", "do", "how", "which", "who", "when", "where", "can", "could", "would", "should", "rule", "rules", "about", "tell", "me", "explain", "describe", "say", "says", "that", "this", "there", "are", "was", "were", "been", "have", "has", "had", "any", "all", "some", "an", "my", "its", "if", "then", "than", "into", "also", "between", "during", "after", "before"]
STOP_WORDS_POLICIES = ["what", "is", "the", "and", "or", "of", "to", "in", "a", "for", "with", "on", "at", "by", "from", "under", "across", "vs", "versus", "compare", "coverage", "exclusions", "policy", "policies", "insurance", "pds", "carrier", "carriers", "limits", "maximum", "limit", "amount", "any", "which", "who", "offer", "offers", "detailed", "sidebyside", "comparison", "between", "how", "does", "do", "they", "terms", "conditions", "cover", "covered", "excluded", "stance"]

RULE_NUMBER = r"(?:^|\n)\s*(\d{1,2}\.\d{1,3}(?:\.\d{1,2})?)\b"
CROSS_REFERENCE = r"\[(\d{1,2}\.\d{1,3}(?:\.\d{1,2})?)\]|(?:see|See|SEE)\s+(?:\[)?(\d{1,2}\.\d{1,3}(?:\.\d{1,2})?)(?:\])?|(?:rule|Rule|RULE)\s+(\d{1,2}\.\d{1,3}(?:\.\d{1,2})?)|EXC:\s*\[(\d{1,2}\.\d{1,3}(?:\.\d{1,2})?)\]"
CHASED_REFERENCE = r"\[(\d{1,2}\.\d{1,3}(?:\.\d{1,2})?)\]|(?:see|See)\s+(?:\[)?(\d{1,2}\.\d{1,3}(?:\.\d{1,2})?)(?:\])?|EXC:\s*\[(\d{1,2}\.\d{1,3}(?:\.\d{1,2})?)\]"
SECTION_HEADER = r"(?:^|\n)\s*(\d{1,2})\.\s+([A-Z][A-Z\s&\-]+)"
QUESTION_MARK = r"(?:^|\n)\s*(?:Q\.|A\.|CLARIFICATION:|VARIANT:)"
SCENARIO_LETTER = r"(?:^|\n)\s*([A-K])[.:]\s+"
SCENARIO_NAMED = r"[Ss]cenario\s+([A-K])\b"
ERRATA_SEPARATOR = r"[•·]\.{4,}"
PAGE_MARKER = r"^--- PAGE (\d+)"
RULE_TAG = r"\[Rule:\s*([\d.]+)\]"
PAGE_REFERENCE = r"(?i)(?:page|pages)\s+(\d+)"

#: name, pattern of rule numbers, pattern of cross references
RULE_SCHEMAS = [
    ("chapter_decimal", r"(?:^|\s)([A-Z]\d{1,2}\.\d{1,4})\b", r"\(([A-Z]\d{1,2}\.\d{1,4})\)|\[EXC:\s*([A-Z]\d{1,2}\.\d{1,4})[^\]]*\]|(?:see|See|SEE)\s+([A-Z]\d{1,2}\.\d{1,4})"),
    ("numeric_decimal", RULE_NUMBER, CROSS_REFERENCE),
    ("outline_parenthetical", r"\(([A-Z]\d{1,2}\.\d{1,3})\)", r"\(([A-Z]\d{1,2}\.\d{1,3})\)"),
    ("keyword_header", r"(?:^|\n)([A-Z\s]{4,})\n", r"(?:see|See|SEE)\s+(?:page\s+\d+|[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)"),
]
#: name and pattern that detects it
SCENARIO_FORMATS = [
    ("letter", r"Scenario\s+[A-K]\b|^[A-K][.:]\s+[A-Z]"),
    ("numeric", r"ASL\s+\d+|Scenario\s+\d+|^(?:Scenario\s+)?\d+[.:]"),
    ("named", r"SCENARIO\s+DESIGN|Special\s+Scenario\s+Rules|SSR"),
]
#: pattern of the file name, document type, priority
FILE_NAME_RULES = [
    (r"errata", "errata", 3),
    (r"hasl.*errata", "errata", 3),
    (r"scenario.*errata", "scenario_errata", 4),
    (r"scenario.*balance", "scenario_balance", 5),
    (r"version.*tracker", "version_tracker", 2),
    (r"qa|q&a|q_a", "qa", 6),
    (r"journal", "journal", 6),
    (r"variant|house.*rule", "variant", 7),
    (r"tournament", "tournament", 7),
    (r"codex", "codex", 2),
    (r"primer|intro|what.is", "primer", 9),
    (r"scenario[a-z]$", "scenarios", 8),
    (r"scenario[a-z0-9]+$", "scenarios", 8),
    (r"^ap\d+", "scenarios", 8),
    (r"^pp\d+", "scenarios", 8),
    (r"^scenario[ta-z]\d*$", "scenarios", 8),
    (r"scenarios.*\d", "scenarios", 8),
    (r"1st.*edition|1st.*ed", "core_rules_v1", 9),
    (r"2nd.*edition|2nd.*ed", "core_rules", 1),
    (r"replacement.*page", "errata", 3),
    (r"vb$", "errata", 3),
]
#: pattern of the content, document type, priority
CONTENT_RULES = [
    (r"published errata", "errata", 3),
    (r"balance errata", "scenario_balance", 5),
    (r"scenario.*errata", "scenario_errata", 4),
    (r"questions and answers", "qa", 6),
    (r"clarifications and errata", "qa", 6),
    (r"version tracker", "version_tracker", 2),
    (r"2nd edition.*rules|rules.*2nd", "core_rules", 1),
    (r"1st edition.*rules|rules.*1st", "core_rules_v1", 9),
    (r"introduction to the (1st|2nd)", "core_rules", 1),
    (r"asl scenario\s+\w+\d+", "scenarios", 8),
    (r"turn record chart", "scenarios", 8),
    (r"asl journal", "journal", 6),
    (r"codex", "codex", 2),
    (r"variant|house rule|optional rule", "variant", 7),
    (r"replacement page", "errata", 3),
]
PRIORITIES = {"core_rules": 1, "codex": 2, "version_tracker": 2, "errata": 3, "scenario_errata": 4, "scenario_balance": 5, "qa": 6, "journal": 6, "scenarios": 8, "tournament": 7, "variant": 7, "core_rules_v1": 9, "primer": 9, "supplement": 8, "unknown": 9}
RULE_TYPES = ["core_rules", "core_rules_v1", "errata", "scenario_errata", "integrated_rules", "version_tracker", "codex"]
SCENARIO_TYPES = ["scenarios", "scenario_balance", "tournament"]
#: file name, document type, priority, description
DOCUMENTS = [
    ("UF RuleBook updated.pdf", "integrated_rules", 1, "Definitive merged reference — core rules interleaved with Q&A/errata"),
    ("Up_Front.pdf", "core_rules", 2, "Original 1983 core rules"),
    ("Up_Front_Errata_Pages.pdf", "errata", 3, "Standalone errata organized by rule number"),
    ("UF_Scenarios_2-4.pdf", "scenario_errata", 4, "Scenario pack Q&A and errata"),
    ("UF_Scenarios_2-5.pdf", "scenario_errata", 4, "Scenario pack update"),
    ("Upfront_Scenarios_1.pdf", "scenarios", 5, "Scenarios A-J with setup, OOBs, victory conditions"),
    ("Up_Front-_Experimental_house_and_variant_rules.pdf", "variant", 6, "Variant/house rules (non-official)"),
    ("origins_87_tournament_rules.pdf", "tournament", 7, "Origins 1987 tournament rules"),
    ("What_is_UpFront.pdf", "primer", 8, "Beginner overview"),
    ("up-front-rules.pdf", "core_rules", 2, "Scanned core rules (may be duplicate of Up_Front.pdf)"),
]
CARRIERS = {"aami-home-contents-insurance-pds.pdf": "AAMI", "cba-home-pds.pdf": "CBA", "FSR_HomeContentInsPDS.pdf": "Westpac_FSR", "FSR_HomeContentInsPDS_pre21Dec2025.pdf": "Westpac_FSR_Pre2025", "home-and-contents-insurance-pds.pdf": "Allianz_NAB", "home-insurance-ped-current.pdf": "RACV_PED", "pds.pdf": "CGU_ANZ", "POL1388TIO.pdf": "TIO"}
#: patterns of acronyms and meanings: each has both as groups, in either order
ACRONYMS = [
    r"([A-Z][A-Za-z\-]+(?:\s+[A-Z][A-Za-z\-]+){0,4})\s*\(([A-Z]{2,5}[a-z]?)\)",
    r"([A-Z]{2,5}[a-z]?)\s*\(([A-Z][A-Za-z\-]+(?:\s+[A-Z][A-Za-z\-]+){0,4})\)",
    r"([A-Z][A-Za-z\-]+(?:\s+[A-Z][A-Za-z\-]+){0,4})\s*\[([A-Z]{2,5}[a-z]?)\]",
    r"\b([A-Z]{2,5}[a-z]?):\s*([A-Z][A-Za-z\-]+(?:\s+[A-Z][A-Za-z\-]+){0,4})",
]
#: armour facing and the range of centres that it lies in
FACINGS = [("Turret Armor", 60, 135), ("Stern Armor", 140, 215), ("Left Armor", 220, 295), ("Front Armor", 305, 380), ("Right Armor", 385, 460), ("Bottom Armor", 470, 545)]
#: height above which the first unit of a sheet lies
UNIT_HEIGHT = 265
#: internal grid, its range of x and its number of columns
GRIDS = [("Turret Internals", 60, 130, 10), ("Bottom Internals", 470, 540, 10), ("Main Internals", 140, 450, 46)]
KEYWORD_WEIGHT, PRIORITY_WEIGHT, DEFAULT_DISTANCE, DEFAULT_PRIORITY = 0.12, 0.05, 0.5, 9
#: types of a question; one that a model makes up counts as the second
QUERY_TYPES = ["direct_rule", "concept", "situation", "scenario", "comparison", "variant"]
#: values of a judge
ASPECTS = ["faithfulness", "relevancy", "citation"]
NOTHING_FOUND = {"rules": "No matching rules found in the database.", "policies": "No matching policy documents found.", "listings": "No matching listings found."}
