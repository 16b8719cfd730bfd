"""Patterns of headers, lots, clients and companies, in the order they are tried."""

ROLES = ("designation", "unite", "quantite", "prix_unitaire", "prix_total")

_PU = (r"prix\s*(?:unitaire|unit\.?)(?:\s*h\.?t\.?)?", r"p\.u\.(?:\s*h\.?t\.?)?")
_PT = (r"prix\s*(?:total|tot\.?)(?:\s*h\.?t\.?)?", r"montant(?:\s*h\.?t\.?)?", r"p\.t\.(?:\s*h\.?t\.?)?",
       r"pt(?:\s*h\.?t\.?)?", r"total(?:\s*h\.?t\.?)?")

# Header patterns per role and profile.
HEADER = {
    "main": {
        "designation": (
            "désignation", "designation", "libellé", "libelle", "description", "prestation", "article", "détail",
            "detail", "ouvrage", "intitulé", "intitule", "nature", "objet", "travaux", "ouvrages?", "prestations?",
            "descriptions?", "libelles?", "n°.*art.*", "ref.*art.*", "code.*art.*", r"art\.?.*dés.*", "dés.*art.*"),
        "unite": ("unité", "unite", r"u\.?$", r"un\.?$", "un$", "unité de mesure", "mesure", "unit", "^u$", "unités",
                  "mesures", "type.*unit.*", "unit.*mes.*"),
        "quantite": ("quantité", "quantite", r"qté\.?", r"qt\.?", r"quant\.?", "qte", "nombre", r"nb\.?", r"q\.?$",
                     "qtés?", "quantités", "nbres?", "nombres"),
        "prix_unitaire": _PU + (r"pu(?:\s*h\.?t\.?)?$", "prix$", r"pu\s*ht$", r"prix\s*ht$", "coût.*unit.*",
                                "tarif.*unit.*", "€.*unit.*", "euro.*unit.*", "prix.*€", "tarif", "coût", "montant.*unit.*"),
        "prix_total": _PT + ("sous.*total", "coût.*total", "€.*total", "somme", "montants?"),
    },
    "service": {
        "designation": ("désignation", r"des(?:\.|ignat)", "libellé", "description", "intitulé", "détail des ouvrages"),
        "unite": ("unité", r"u\.", r"un\.", "un$", "unité de mesure", "mesure"),
        "quantite": ("quantité", r"qté\.?", r"qt\.?", r"quant\.?", "qte"),
        "prix_unitaire": _PU + (r"pu(?:\s*h\.?t\.?)?",),
        "prix_total": _PT,
    },
    "improved": {
        "designation": ("désignation", "libellé", "description", "prestation", "article", "détail", "ouvrage", "intitulé",
                        "nature"),
        "unite": ("unité", r"u\.", r"un\.", "un$", "unité de mesure", "mesure"),
        "quantite": ("quantité", r"qté\.?", r"qt\.?", r"quant\.?", "qte"),
        "prix_unitaire": _PU + (r"pu(?:\s*h\.?t\.?)?",),
        "prix_total": _PT,
    },
    "shared": {
        "designation": ("désignation", "designation", "libellé", "libelle", "description", "des ouvrages", "intitulé",
                        "detail", "détail", "ouvrages"),
        "unite": ("unité", "unite", r"u\.?$", r"un\.?$", "un$"),
        "quantite": ("quantité", "quantite", r"qté\.?", r"qt\.?", r"quant\.?", "qté", "qte"),
        "prix_unitaire": (r"prix\s*(?:unitaire|unit\.?)", r"p\.u\.", "pu", r"pu\s*ht"),
        "prix_total": (r"prix\s*(?:total|tot\.?)", "montant", r"p\.t\.", "pt", "total", "ttc"),
    },
}
# Column patterns where they differ from the header patterns.
COLUMNS = {
    "main": {
        "designation": HEADER["main"]["designation"][:13],
        "unite": ("unité", "unite", r"u\.?$", r"un\.?$", "un$", "unité de mesure", "mesure", "^u$"),
        "quantite": ("quantité", "quantite", r"qté\.?", r"qt\.?", r"quant\.?", "qte"),
        "prix_unitaire": _PU + (r"pu(?:\s*h\.?t\.?)?", r"pu\s*ht$", r"prix\s*ht$"),
        "prix_total": _PT,
    },
    "service": {**HEADER["service"], "designation": HEADER["service"]["designation"][:5]},
    "shared": {**HEADER["shared"], "designation": HEADER["shared"]["designation"][:9]},
    "scored": {
        "designation": HEADER["main"]["designation"][:13] + ("désig", "desig", "libel", "descr", "prest"),
        "unite": HEADER["main"]["unite"][:11],
        "quantite": HEADER["main"]["quantite"][:10] + ("quantités", "qtite", "quantit"),
        "prix_unitaire": _PU + (r"pu(?:\s*h\.?t\.?)?$", "prix$", r"pu\s*ht$", r"prix\s*ht$", r"p\.u", "px.*unit"),
        "prix_total": _PT + (r"p\.t", "px.*tot", "mont", "tot"),
    },
}
# Rows scanned, columns scanned, least score, score that stops the scan, row text tested.
HEADER_RULES = {"main": (30, None, 2, 4, True), "service": (50, 15, 3, 4, False), "improved": (30, None, 3, 5, True),
                "shared": (20, None, 2, 2, True)}
UNIT_LIKE = ("m2", "m²", "ml", "u", "ens", "kg", "h", "j", "forfait", "ft")

_N = r"[\w\s\-&°'\.]"
# Lot in a file name: number, then name where there is a second group.
LOT_FILE = {
    "main": (
        rf"lot\s*(\d{{1,2}})\s*-\s*(?:dpgf|devis|bpu|dqe)\s*-\s*({_N}+)",
        rf"dpgf\s*[-_]?\s*lot\s*(\d{{1,2}})\s+({_N}+)",
        rf"lot\s*(\d{{1,2}})\s*-\s*({_N}+)",
        rf"^\d+\s+dpgf\s+lot\s*(\d{{1,2}})\s*-\s*({_N}+)",
        rf"dpgf\s+lot\s*(\d{{1,2}})\s*-\s*({_N}+)",
        rf"lot\s*(\d{{1,2}})[_\-\s]+({_N}+)",
        rf"-\s*dpgf\s*-?\s*lot\s*(\d{{1,2}})\s*-?\s*({_N}*)",
        rf"[\[\(][\w\s]+[\]\)]\s*-\s*lot\s*(\d{{1,2}})\s*-\s*({_N}+)",
        rf"(?:dce|bce|appel|marche|projet)[-_\s]*lot[-_\s]*(\d{{1,2}})[-_\s]+({_N}+)",
        rf"(?:chantier|projet|travaux)[-_\s]*[\w\s]*[-_\s]*lot[-_\s]*(\d{{1,2}})[-_\s]+({_N}+)",
        rf"(?:cdc|bnp|axa|vinci|bouygues)[-_\s]*(?:habitat|group|immobilier)?[-_\s]*lot[-_\s]*(\d{{1,2}})[-_\s]+({_N}+)",
        rf"lot(\d{{1,2}})\s*-\s*({_N}+)",
        rf"lot[-_](\d{{1,2}})[-_]({_N}+)",
        rf"(\d{{1,2}})[-_\s]*({_N}+)[-_\s]*lot",
        r"lot\s*(\d{1,2})(?:[^\w\d]|$)",
        r"\bL(\d{1,2})\b",
        rf"^(\d{{1,2}})\s*-\s*({_N}{{5,}})",
        rf"[\\/]lot[-_\s]*(\d{{1,2}})[-_\s]*({_N}*)",
    ),
    "service": (
        r"lot\s*(\d+)\s*-\s*(?:dpgf|devis)\s*-\s*([\w\s-]+)", r"lot\s*(\d+)\s*-\s*([\w\s-]+)",
        r"dpgf\s*lot\s*(\d+)\s*-\s*([\w\s-]+)", r"lot\s*(\d+)[_\-\s]+([\w\s-]+)", r"lot\s*(\d+)",
        r"(\d{1,2})\s+([\w\s-]+)"),
    "enhanced": (
        rf"lot\s*(\d{{1,2}})\s*-\s*(?:dpgf|devis|bpu|dqe)\s*-\s*({_N}+)",
        rf"dpgf\s*[-_]?\s*lot\s*(\d{{1,2}})\s+({_N}+)", rf"lot\s*(\d{{1,2}})\s*-\s*({_N}+)",
        rf"^\d+\s+dpgf\s+lot\s*(\d{{1,2}})\s*-\s*({_N}+)", rf"lot\s*(\d{{1,2}})[_\-\s]+({_N}+)",
        rf"(\d{{1,2}})\s*[-_]\s*({_N}+)", r"-\s*dpgf\s*-?\s*lot\s*(\d{1,2})", r"lot\s*(\d{1,2})(?:\D|$)"),
    "number": (r"LOT[\s\._-]*(\d+[A-Z]?)", r"LOT[\s\._-]*([A-Z\d]+)[\s\._-]", r"-[\s]*LOT[\s]*(\d+[A-Z]?)"),
}
LOT_WORDS = "lot dpgf bpu dqe devis bordereau".split()
LOT_PATH = rf"[\\/]lot[-_\s]*(\d{{1,2}})[-_\s]*({_N}*)"
LOT_CELL = (r"lot\s+([^\s–-]+)\s*[–-]\s*(.+)",)
# Lot titles of the service variant; the last one is case-sensitive.
LOT_CELL_SERVICE = (r"(?i)lot\s+n?[°\.]?\s*([^\s\-–]+)\s*[\-–:]\s*(.+)", r"(?i)lot\s+n?[°\.]?\s*([^\s\-–]+)()[\s\-–:]*$",
                    r"^([0-9]{1,2})[\.]\s+([A-Z].+)$")

# Client in a file name.
CLIENT_FILE = (
    r"DPGF[_\-\s]*([A-Z][A-Za-z\s&'\.]+?)[_\-\s]*Lot", r"([A-Z][A-Za-z\s&'\.]+?)[\-_\s]*DPGF",
    r"Client[_\-\s]*([A-Z][A-Za-z\s&'\.]+)", r"([A-Z]{2,}[\s&][A-Z\s'\.]+)", r"^((?:[A-Z][a-zA-Z'\.]+\s*)+)",
    r"[\\/]([A-Z][A-Za-z\s&'\.]+?)[\\/][^\\/]+\.xlsx$", r"(?:projet|chantier)[_\-\s]+([A-Z][A-Za-z\s&'\.]+)",
    r"_([A-Z][a-z]{2,}(?:[A-Z][a-z]+)+)_")
# Client in the text of a row (any case).
CLIENT_ROW = (
    r"(?:client|maître d'ouvrage|maitre d'ouvrage|donneur d'ordre)[^\w\n]{1,5}([A-Z][A-Za-z\s&'\.]{2,})",
    r"(?:pour|destiné à|réalisé pour)[^\w\n]{1,5}([A-Z][A-ZaZ\s&'\.]{2,})",
    r"(?:société|entreprise|groupe)[^\w\n]{1,5}([A-Z][A-ZaZ\s&'\.]{2,})",
    r"^([A-Z][A-z]+(?:[\s\-][A-Z][A-z]+){1,3})\s*$",
    r"Projet\s*(?:pour|de|avec)?\s*(?:la|le)?\s*([A-Z][A-Za-z\s&'\.]{2,})",
    r"Chantier\s*(?:de|pour)?\s*([A-Z][A-ZaZ\s&'\.]{2,})",
    r"(?:SA|SAS|SARL|GROUP|HABITAT)\s+([A-Z][A-ZaZ\s&'\.]{2,})",
    r"([A-Z][A-ZaZ\s&'\.]{2,})\s+(?:SA|SAS|SARL|GROUP|HABITAT)")
# Client in a cell (case-sensitive).
CLIENT_CELL = (
    r"^([A-Z]{2,}(?:\s+[A-Z&'\.]+)*)\s*$",
    r"([A-Z][a-z]+(?:\s+[A-Z][a-z'\.]+)*)\s*(?:HABITAT|GROUP|COMPANY|SA|SAS|SARL|SCI|IMMOBILIER)",
    r"((?:[A-Z]{2,}\s*)+)(?:HABITAT|GROUP|IMMOBILIER)",
    r"(?:^|\s)([A-Z][a-zA-Z'\.]+(?:\s+[A-Z][a-zA-Z'\.]+){1,3})(?:\s|$)",
    r"(?:^|\s)([A-Z]{2,}(?:\s*[A-Z]{2,}){0,2})(?:\s|$)",
    r"(?:société|entreprise|groupe|client|constructeur)\s+([A-Z][a-zA-Z'\.]+(?:\s+[A-Z][a-zA-Z'\.]+){0,3})",
    r"[Pp]our\s+(?:le\s+compte\s+de\s+)?([A-Z][a-zA-Z'\.]+(?:\s+[A-Z][a-zA-Z'\.]+){0,3})",
    r"[Aa]dresse\s*:?\s*(?:[^,]+,\s*)?([A-Z][a-zA-Z'\.]+(?:\s+[A-Z][a-zA-Z'\.]+){1,3})",
    r"(?:^|\n)\s*([A-Z][a-zA-Z'\.]+(?:\s+[A-Z][a-zA-Z'\.]+){1,2})\s*(?:$|\n)")
# Known companies.
COMPANIES = (
    "CDC HABITAT", "VINCI", "BOUYGUES", "EIFFAGE", "AXA", "BNP", "ICADE", "NEXITY", "KAUFMAN", "COGEDIM", "PITCH",
    "PICHET", "AMETIS", "ADIM", "SOGEPROM", "MARIGNAN", "DEMATHIEU BARD", "ALTAREA", "CREDIT AGRICOLE",
    "SOCIETE GENERALE", "CARREFOUR", "LECLERC", "AUCHAN", "LEROY MERLIN", "CASTORAMA", "LIDL", "ALDI", "COLAS")
CLIENT_LABEL = (r"client\s*:\s*([^,;:]+)", r"maître\s*d['\"]ouvrage\s*:\s*([^,;:]+)", r"mo\s*:\s*([^,;:]+)")
PROJECT_SKIP = ("DPGF", "QUANTITATIF", "BORDEREAU")
PROJECT_LOT = r"Lot\s*(\d+)[^\w]*([\w\s\-]+?)(?:\.xlsx|$)"
