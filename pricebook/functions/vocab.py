"""Word lists, unit maps and character tables the results depend on."""

# Accents folded by the name normalizer, then all accents for file names.
ACCENTS = ("éèêëàâäùûüîïôöç", "eeeeaaauuuiiooc")
ALL_ACCENTS = ("éèêëàâäáãåùûüúîïíìôöóòõçñÿýÉÈÊËÀÂÄÁÃÅÙÛÜÚÎÏÍÌÔÖÓÒÕÇÑÝ",
               "eeeeaaaaaauuuuiiiiooooocnyyEEEEAAAAAAUUUUIIIIOOOOOCNY")

# Wrongly decoded sequences and their repair.
MOJIBAKE = (
    ("Ã©", "é"), ("Ã¨", "è"), ("Ã ", "à"), ("Ã§", "ç"), ("Ã¹", "ù"), ("Ãª", "ê"), ("Ã´", "ô"), ("Ã®", "î"),
    ("Ã¯", "ï"), ("Ã«", "ë"), ("Ã‰", "É"), ("Ãˆ", "È"), ("Ã€", "À"), ("Ã‡", "Ç"), ("Ã™", "Ù"),
    ("ï¿½", ""), ("�", ""),
)

# Words that are never part of a client name.
CLIENT_IGNORE = (
    "LOT DPGF NOVEMBRE DECEMBRE JANVIER FEVRIER MARS AVRIL MAI JUIN JUILLET AOUT SEPTEMBRE OCTOBRE DCE "
    "CONSTRUCTION TRAVAUX BATIMENT APPEL OFFRE MARCHE MAITRISE OEUVRE PROJET CHANTIER RENOVATION "
    "REHABILITATION DEVIS ESTIMATION PRIX DOCUMENT BORDEREAU QUANTITATIF REFERENCE DESCRIPTION CODE "
    "UNITE TOTAL EUROS EUR HT TTC"
).split()

# Noise words of lot names (main, small variant) and of fallback names.
LOT_NOISE = "dpgf bpu dqe devis bordereau quantitatif prix lot".split()
LOT_NOISE_SMALL = "dpgf bpu dqe devis bordereau prix unitaire".split()
LOT_FALLBACK_SKIP = "lot de du la le et".split()
FALLBACK_IGNORE = (
    "dpgf bpu dqe devis bordereau quantitatif prix lot document fichier excel pdf word nouveau final "
    "version copie backup temp draft brouillon"
).split()
FALLBACK_IGNORE_SMALL = "dpgf bpu dqe devis bordereau prix unitaire projet chantier travaux".split()

# Unit spellings to normalized units, tried in this order.
UNITS = (
    ("m²", "m2"), ("M²", "m2"), ("M2", "m2"), ("mètres carrés", "m2"), ("metres carres", "m2"),
    ("dm²", "dm2"), ("cm²", "cm2"), ("hectare", "ha"),
    ("m.l.", "ml"), ("mètre linéaire", "ml"), ("metre lineaire", "ml"), ("mètres linéaires", "ml"),
    ("mètre", "m"), ("metre", "m"), ("millimètre", "mm"), ("millimetre", "mm"),
    ("centimètre", "cm"), ("centimetre", "cm"), ("kilomètre", "km"), ("kilometre", "km"),
    ("m³", "m3"), ("M³", "m3"), ("M3", "m3"), ("mètres cubes", "m3"), ("metres cubes", "m3"),
    ("dm³", "dm3"), ("cm³", "cm3"), ("litre", "L"),
    ("kilogramme", "kg"), ("kilo", "kg"), ("gramme", "g"), ("tonne", "t"),
    ("unité", "u"), ("unite", "u"), ("pièce", "u"), ("piece", "u"), ("pce", "u"), ("pc", "u"),
    ("ensemble", "ens"), ("paire", "pr"), ("boîte", "boite"), ("boite", "boite"),
    ("heure", "h"), ("jour", "j"), ("journée", "j"), ("journee", "j"),
    ("forfait", "ft"), ("global", "gb"),
)

# Words telling lump-sum and open-price items.
FORFAIT_WORDS = (
    "forfait", "ft", "global", "ensemble", "prestation", "intervention", "déplacement", "deplacement", "minimum",
    "heure", "jour", "semaine", "mois", "période", "periode")
VARIABLE_WORDS = (
    "variable", "provisoire", "éventuel", "eventuel", "optionnel", "selon", "suivant", "conformément",
    "conformement", "à définir", "a definir", "à préciser", "a preciser")

# Trades and their words, first trade that matches wins (main and small table).
TRADES = (
    ("Gros Oeuvre", ("gros", "oeuvre", "béton", "beton", "maçonnerie", "maconnerie", "structure")),
    ("Charpente", ("charpente", "bois", "ossature")),
    ("Couverture", ("couverture", "toiture", "zinc", "tuile", "ardoise")),
    ("Menuiserie", ("menuiserie", "fenêtre", "fenetre", "porte", "volet")),
    ("Serrurerie", ("serrurerie", "métallerie", "metallerie", "acier", "fer")),
    ("Plomberie", ("plomberie", "sanitaire", "eau", "évacuation", "evacuation")),
    ("Electricite", ("électricité", "electricite", "éclairage", "eclairage", "courant")),
    ("Peinture", ("peinture", "revêtement", "revetement", "finition")),
    ("Isolation", ("isolation", "thermique", "phonique")),
    ("Carrelage", ("carrelage", "faïence", "faience", "sol")),
    ("Cloisons", ("cloison", "doublage", "plâtre", "platre")),
    ("Vrd", ("vrd", "voirie", "réseau", "reseau", "assainissement")),
    ("Espaces Verts", ("espaces", "verts", "paysager", "jardinage", "plantation")),
)
TRADES_SMALL = (
    ("Menuiserie", ("menuiserie", "menuiser", "bois", "porte", "fenetre", "fenêtre")),
    ("Plomberie", ("plomberie", "plomb", "eau", "sanitaire", "wc", "salle de bain")),
    ("Électricité", ("electricite", "electrique", "elec", "courant", "tableau", "prise")),
    ("Carrelage", ("carrelage", "carrel", "faience", "faïence", "sol", "mur")),
    ("Peinture", ("peinture", "peint", "finition", "decoration", "décoration")),
    ("Maçonnerie", ("maconnerie", "macon", "beton", "béton", "mur", "cloison")),
    ("Métallerie", ("metallerie", "metal", "métal", "serrurerie", "fer", "acier")),
)

# Article numbers split from a designation.
ARTICLE_SPLIT = (
    r"^[A-Z]\d+(?:\.\d+)*$", r"^\d+(?:\.\d+){1,4}$", r"^[A-Z]{1,3}\.\d+(?:\.\d+)*$",
    r"^\d{2,4}[A-Z]?$", r"^[A-Z]\d{2,4}$")
# Article numbers accepted as evidence of an element.
ARTICLE_EVIDENCE = ARTICLE_SPLIT + (
    r"^\d+[A-Z]\d+$", r"^Art\.\s*\d+", r"^\d+\s*-", r"^\d+\)", r"^\w+\.\w+\.\w+")
