"""Section patterns and the evidence words of priced elements."""

# Section patterns of the main profile, in order.
# name, pattern, any case, number rule, level rule
SECTIONS = (
    ("numbered_standard", r"^(\d+(?:\.\d+)*)\s+(.+)", False, "number", "separators"),
    ("numbered_punctuated", r"^(\d+(?:\.\d+)*)[.-]\s*(.+)", False, "number", "separators"),
    ("hierarchical_complex", r"^([A-Z]?\d{1,2}(?:\.\d{1,2}){1,4})\s+(.+)", False, "number", "dots_or_code"),
    ("letter_number", r"^([A-Z]\d{1,3})\s+(.+)", False, "number", "2"),
    ("lot_subsection", r"^(LOT\s+\d{1,2}(?:\.\d+)*)\s+(.+)", True, "number", "dotted"),
    ("article_numbered", r"^(ART\.?\s*\d+)\s+(.+)", True, "number", "dotted"),
    ("uppercase_title", r"^([A-Z][A-Z\s\d\.\-\_\&']{4,})$", False, "hash_S", "1"),
    ("underlined_title", r"^([=\-_]{3,})\s*([A-Z].{3,})\s*[=\-_]{3,}$", False, "hash_TITLE", "1"),
    ("roman_numeral", r"^([IVX]{1,5})[.\-\s]\s*(.+)", False, "number", "1"),
    ("letter_numeral", r"^([A-H])[.\-\s]\s*(.+)", False, "number", "2"),
    ("prefixed_section", r"^(CHAPITRE|LOT|PARTIE|SECTION|SOUS-SECTION|TITRE)\s+([A-Z0-9]+)[\s\:]*(.*)", False, "prefix", "1"),
    ("technical_prefix", r"^(POSTE|OUVRAGE|PRESTATION|TRAVAUX|FOURNITURE)\s+([A-Z0-9\.]+)[\s\:]*(.*)", False, "prefix", "1"),
    ("total_section", r"^(SOUS[\-\s]*TOTAL|TOTAL|MONTANT\s+TOTAL|RÉCAPITULATIF|RECAPITULATIF)[\s\:]*(.*)", False, "total", "total"),
    ("sharepoint_numbered", r"^(\d+\.\d+(?:\.\d+)*)\s*(.*)", False, "number", "separators"),
    ("sharepoint_dashed", r"^(\d+\-\d+(?:\-\d+)*)\s+(.+)", False, "number", "dashes"),
    ("parentheses_numbered", r"^\(([A-Z0-9]+)\)\s+(.+)", False, "number", "digit"),
    ("brackets_numbered", r"^\[([A-Z0-9]+)\]\s+(.+)", False, "number", "digit"),
    ("dash_section", r"^\s*[-•]\s+([A-Z].{5,})$", False, "hash_SEC", "2"),
    ("bullet_section", r"^\s*[•◦▪▫]\s+([A-Z].{5,})$", False, "hash_SEC", "2"),
    ("decimal_french", r"^(\d+(?:,\d+)*)\s+(.+)", False, "number", "commas"),
    ("ordinal_french", r"^(\d+(?:er|ème|nd|rd|th))\s+(.+)", False, "number", "commas"),
    ("phase_step", r"^(PHASE|ÉTAPE|ETAPE|STADE)\s+([A-Z0-9]+)\s*[\:\-]?\s*(.*)", False, "prefix", "1"),
    ("zone_sector", r"^(ZONE|SECTEUR|PÉRIMÈTRE|PERIMETRE)\s+([A-Z0-9]+)\s*[\:\-]?\s*(.*)", False, "prefix", "1"),
    ("mixed_alphanumeric", r"^([A-Z]\d+(?:\.\d+)*)\s+(.+)", False, "number", "separators"),
    ("complex_codes", r"^([A-Z]{2,4}\d{2,4})\s+(.+)", False, "number", "2"),
    ("fraction_numbered", r"^(\d+/\d+)\s+(.+)", False, "number", "fraction"),
    ("version_numbered", r"^(V\d+(?:\.\d+)*|REV\.?\d+)\s+(.+)", False, "number", "1"),
)
_BY_NAME = {s[0]: s for s in SECTIONS}
# The shorter lists of the other profiles.
SECTIONS_ENHANCED = tuple(_BY_NAME[n] for n in (
    "numbered_standard", "numbered_punctuated", "uppercase_title", "roman_numeral", "letter_numeral")) + (
    ("prefixed_section", r"^(CHAPITRE|LOT|PARTIE|SECTION|SOUS-SECTION)\s+([A-Z0-9]+)[\s\:]*(.*)", False, "prefix", "1"),
    ("total_section", r"^(SOUS[\-\s]*TOTAL|TOTAL|MONTANT\s+TOTAL)[\s\:]*(.*)", False, "total", "2"),
    _BY_NAME["sharepoint_numbered"],
    ("complex_article", r"^([A-Z]?\d{1,2}(?:\.\d{1,2}){2,})\s+(.+)", False, "number", "separators"),
    _BY_NAME["dash_section"])
SECTIONS_SERVICE = (
    ("numbered", r"^(\d+(?:\.\d+)*)\s+(.*)", False, "number", "separators"),
    ("uppercase", r"^([A-Z][A-Z\s\d\.]+)$", False, "title", "1"))
SECTIONS_SHARED = (
    ("numbered_sp", r"^(\d+(?:\.\d+)+)\s+(.*)", False, "number", "separators"),
    ("numbered", r"^(\d+(?:\.\d+)*)\s+(.*)", False, "number", "separators"),
    ("uppercase", r"^([A-Z][A-Z\s\d\.]+)$", False, "hash_S", "1"))
PROFILES = {"main": SECTIONS, "enhanced": SECTIONS_ENHANCED, "service": SECTIONS_SERVICE, "improved": SECTIONS_SERVICE,
            "shared": SECTIONS_SHARED}

# Technical words of the main profile.
TECHNICAL = (
    "fourniture", "pose", "f et p", "f&p", "fp", "fourni et posé", "fourni posé", "installation", "montage",
    "mise en place", "mise en œuvre", "mise en oeuvre",
    "démolition", "demolition", "dépose", "depose", "découpe", "decoupe", "perçage", "percage", "calfeutrement",
    "étanchéité", "etancheite", "isolation", "raccordement", "scellement", "fixation", "assemblage", "soudure",
    "vissage", "clouage",
    "maçonnerie", "maconnerie", "béton", "beton", "ferraillage", "coffrage", "banche", "charpente", "couverture",
    "zinguerie", "bardage", "façade", "facade", "cloison", "doublage", "plafond", "sol", "carrelage", "faïence",
    "faience", "peinture", "enduit", "crépi", "crepi", "papier peint", "tapisserie", "menuiserie", "serrurerie",
    "métallerie", "metallerie", "aluminium", "pvc", "plomberie", "sanitaire", "chauffage", "ventilation",
    "climatisation", "vmc", "électricité", "electricite", "éclairage", "eclairage", "tableau électrique", "réseau",
    "reseau", "câblage", "cablage", "gaine", "conduit",
    "acier", "inox", "galvanisé", "galvanise", "laiton", "cuivre", "plomb", "pierre", "marbre", "granit", "calcaire",
    "grès", "gres", "ardoise", "tuile", "zinc", "membrane", "bitume", "epdm", "laine de verre", "laine de roche",
    "polystyrène", "polystyrene", "plaque de plâtre", "ba13", "fermacell", "osb", "contreplaqué", "contreplaque",
    "robinetterie", "appareil", "équipement", "equipement", "accessoire", "poignée", "poignee", "serrure", "cylindre",
    "gâche", "gache", "charnière", "charniere", "paumelle", "pivot", "rail", "guide",
    "finition", "parement", "habillage", "protection", "traitement", "lasure", "vernis", "teinture", "imprégnation",
    "impregnation",
)
# Units known to the main profile, tested by containment in the lower-case cell.
KNOWN_UNITS = (
    "m2", "m²", "mètres carrés", "metres carres", "mc", "m.c.", "dm2", "dm²", "cm2", "cm²", "ha", "hectare",
    "ml", "m.l.", "mètre linéaire", "metre lineaire", "mètres linéaires", "m", "mètre", "metre", "mm", "millimètre",
    "millimetre", "cm", "centimètre", "centimetre", "km", "kilomètre", "kilometre",
    "m3", "m³", "mètres cubes", "metres cubes", "dm3", "dm³", "cm3", "cm³", "litre", "l",
    "kg", "kilogramme", "kilo", "g", "gramme", "t", "tonne",
    "u", "un", "unité", "unite", "pièce", "piece", "pce", "pc", "ens", "ensemble", "jeu", "lot", "série", "serie",
    "paire", "pr", "kit", "boîte", "boite", "sachet", "sac",
    "h", "heure", "j", "jour", "journée", "journee", "semaine", "mois", "année", "annee",
    "forfait", "ft", "f", "global", "gb", "intervention",
    "point", "pt", "passage", "rang", "couche", "application", "appl", "traitement", "trmt",
)
# Contextual phrases and false-positive words.
CONTEXT = (
    "selon dtu", "selon nf", "selon caue", "conforme à", "conforme a", "règles de l'art", "regles de l'art",
    "prescriptions", "cahier des charges", "en façade", "en facade", "en toiture", "en combles", "en sous-sol",
    "à l'étage", "a l'etage", "au rez-de-chaussée", "au rdc", "en extérieur", "en exterieur", "en intérieur",
    "en interieur", "sur chantier", "en atelier", "en usine", "à pied d'œuvre", "a pied d'oeuvre",
    "transport compris", "livraison comprise", "évacuation comprise", "nettoyage compris", "protection comprise",
    "étiquetage compris", "garantie comprise", "maintenance comprise", "entretien compris",
)
FALSE_POSITIVE = (
    "chapitre", "partie", "section", "sous-total", "total général", "total general", "montant total", "récapitulatif",
    "recapitulatif", "sommaire", "désignation", "designation", "quantité", "quantite", "prix unitaire", "prix total",
    "montant", "référence", "reference", "page", "feuille", "annexe", "note", "remarque", "observation",
    "conditions générales", "conditions generales", "modalités", "modalites",
)
# Words of the five-signal profile and of the service profile.
WORK_WORDS = (
    "fourniture", "pose", "installation", "montage", "démontage", "réalisation", "construction", "maçonnerie",
    "peinture", "carrelage", "plomberie", "électricité", "menuiserie", "couverture", "charpente", "isolation",
    "cloisons", "revêtement")
PHRASES = ("fourniture et pose", "f et p", "y compris", "comprise", "inclus", "main d'œuvre", "main d'oeuvre", "mo",
           "m.o.", "matériau", "materiaux")
SMALL_UNITS = ("m2", "m²", "ml", "u", "ens", "kg", "h", "j", "forfait", "ft")
SERVICE_UNITS = ("m2", "m²", "ml", "u", "ens", "ensemble", "unité", "unite", "forfait", "ft")
# Starts of a continuation line; section forms and units of the loose classifier.
CONTINUATION = r"^(?:-|\.|[a-z]|\()"
LOOSE_SECTIONS = (r"^(\d+(?:\.\d+)*)\s+(.+)$", r"^CHAPITRE\s+(\w+)\s*[:-]\s*(.+)$", r"^LOT\s+(\w+)\s*[:-]\s*(.+)$")
LOOSE_UNITS = ("U", "ML", "M2", "M3", "M", "ENS", "F", "PV", "FT")
DEFAULT_SECTION = ("1", "Éléments du bordereau", 1)
