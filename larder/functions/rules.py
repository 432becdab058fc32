"""Fixed values.

Everything in this module is a value that has to be exactly as given for results
to be right: word lists, lookup tables, thresholds and text patterns. There is
no logic here. Larger tables (foods, measures, curated links) are input data and
are read as DataFrames.
"""

# ---------------------------------------------------------------- fixed values: units and quantities
UNIT_SPELLINGS = {
    "gram": "g", "grams": "g", "g": "g", "kg": "kg", "kilogram": "kg", "kilograms": "kg",
    "cup": "cup", "cups": "cup", "tablespoon": "tbsp", "tablespoons": "tbsp", "tbsp": "tbsp",
    "teaspoon": "tsp", "teaspoons": "tsp", "tsp": "tsp", "ml": "ml", "liter": "liter",
    "liters": "liter", "l": "liter", "clove": "clove", "cloves": "clove", "piece": "piece",
    "pieces": "piece", "sprig": "sprig", "sprigs": "sprig", "bunch": "bunch", "inch": "inch",
    "inches": "inch",
}
LINE_UNITS = [
    "tablespoons", "tablespoon", "tbsp", "teaspoons", "teaspoon", "tsp", "cups", "cup", "grams",
    "gram", "kilograms", "kilogram", "kg", "milliliters", "milliliter", "ml", "litres", "liters",
    "litre", "liter", "inch", "inches", "cloves", "clove", "sprigs", "sprig", "pieces", "piece",
    "bunch", "bunches",
]
RUN_TOGETHER_FRACTIONS = {"11/2": 1.5, "21/2": 2.5, "11/4": 1.25}
WATER_GRAMS = {"g": 1.0, "kg": 1000.0, "cup": 250.0, "tbsp": 15.0, "tsp": 5.0, "ml": 1.0, "liter": 1000.0}
WATER_INGREDIENT_ID = "ING00126"
QUALITATIVE_PATTERN = (
    r"(?i)\b(to\s+taste|as\s+per\s+taste|as\s+required|as\s+needed|for\s+cooking|for\s+frying|"
    r"pinch|pinches|handful|handfuls)\b"
)
QUALITATIVE_STATUSES = ["QUALITATIVE_QUANTITY", "ZERO_CALORIE_QUALITATIVE", "ESTIMATED_QUALITATIVE"]
CONVERSION_FAILURES = ["NO_CNF_CONVERSION", "NEEDS_PROXY", "MISSING_QUANTITY"]
STATE_FAILURES = ["STATE_MISMATCH", "STATE_REVIEW_REQUIRED"]

# (unit, priority, description pattern, factor on the measure weight); a lower priority wins,
# then file order.
MEASURE_LADDER = [
    ("cup", 1, r"^250\s*ml$", 1.0), ("cup", 2, r"\b250\s*ml\b", 1.0),
    ("cup", 3, r"\b125\s*ml\b", 2.0), ("cup", 3, r"\b100\s*ml\b", 2.5),
    ("tbsp", 1, r"^15\s*ml$", 1.0), ("tbsp", 2, r"\b15\s*ml\b", 1.0),
    ("tbsp", 3, r"\b5\s*ml\b", 3.0), ("tbsp", 3, r"\b100\s*ml\b", 0.15), ("tbsp", 3, r"\b250\s*ml\b", 0.06),
    ("tsp", 1, r"^5\s*ml$", 1.0), ("tsp", 2, r"\b5\s*ml\b", 1.0),
    ("tsp", 3, r"\b15\s*ml\b", 1.0 / 3.0), ("tsp", 3, r"\b100\s*ml\b", 0.05), ("tsp", 3, r"\b250\s*ml\b", 0.02),
    ("ml", 1, r"\b100\s*ml\b", 1.0 / 100.0), ("ml", 1, r"\b250\s*ml\b", 1.0 / 250.0), ("ml", 1, r"\b15\s*ml\b", 1.0 / 15.0),
    ("clove", 1, r"\bclove\b", 1.0),
    ("piece", 1, r"\bmedium\b", 1.0),
    ("piece", 2, r"\b(whole|fruit|potato|onion|egg|tomato|pepper|banana|apple|cucumber|carrot|lemon|stalk|item)\b", 1.0),
    ("piece", 3, r"\blarge\b", 1.0), ("piece", 4, r"\bslice\b", 1.0),
]
CONTAINER_MEASURE = (
    r"\b(\d+\s*ml|ml|l|liter|litres?|cup|cups|tbsp|tablespoon|tsp|teaspoon|fl\s*oz|can|jar|bag|package|"
    r"packet|container|bottle|glass|tub|packed|box|carton)\b"
)
PEPPER_NAMES = ["black pepper", "peppercorn"]
PEPPER_WHOLE_PATTERN = r"\b(peppercorn|peppercorns|whole)\b"
PEPPER_GRAMS = 0.05
HOUSEHOLD_MEASURE_TYPE = 6

CORE_NUTRIENTS = {
    "208": "energy_kcal", "203": "protein_g", "204": "fat_g", "205": "carbs_g",
    "291": "fiber_g", "269": "sugar_g", "307": "sodium_mg",
}
NUTRIENT_COLUMN_NAMES = {
    "203": "protein_g", "204": "fat_g", "205": "carbs_g", "208": "energy_kcal", "268": "energy_kj",
    "269": "sugar_g", "291": "fiber_g", "307": "sodium_mg",
}
FOOD_FORM_CUES = [
    "raw", "cooked", "boiled", "dry", "dried", "powder", "powdered", "ground", "roasted", "fried",
    "canned", "frozen", "dehydrated", "prepared", "steamed", "baked", "drained", "toasted",
]
NO_FORM = "unspecified_in_description"
COOKED_CUE = r"(?i)\b(cooked|boiled|steamed|soaked)\b"
DRY_FOOD_CUE = r"(?i)\b(dry|raw)\b"

# ---------------------------------------------------------------- fixed values: text cleaning
TITLE_SPONSOR_PATTERNS = [
    r"\s+(?:Using|In|Made Using|Made with)\s+(?:Preethi|Preeti)\s+Electric\s+Pressure\s+Cooker\b",
    r"\s+-\s+Kids\s+Recipes\s+Made\s+With\s+Del\s+Monte\b",
    r"\s+(?:Using|In|Made Using)\s+Electric\s+Pressure\s+Cooker\b",
]
NON_VEG_LABEL_WORDS = ["non", "eggetarian", "meat", "fish", "chicken", "seafood"]
SATVIK_LABEL_WORDS = ["sattvic", "satvik", "no onion no garlic"]
CANDIDATE_PREFIX_PATTERNS = [
    r"^\s*pinch\s+", r"^\s*small\s+teaspoon\s+", r"^\s*small\s+tsp\s+", r"^\s*large\s+teaspoon\s+",
    r"^\s*large\s+tsp\s+", r"^\s*छोटा\s+चमच्च\s+", r"^\s*छोटा\s+चम्मच\s+", r"^\s*बड़ा\s+चमच्च\s+",
    r"^\s*बड़ा\s+चम्मच\s+", r"^\s*इंच\s+", r"^\s*कली\s+", r"^\s*टहनी\s+",
]
CANDIDATE_PREPARATION_PREFIXES = [
    "lukewarm ", "homemade ", "freshly ", "roasted ", "boiled ", "cooked ", "raw ", "ripe ",
]
HINDI_LEXICON = {
    "हल्दी पाउडर": "turmeric powder", "जीरा": "cumin", "जीरा पाउडर": "cumin powder",
    "धनिया पाउडर": "coriander powder", "धनिया": "coriander", "सौंफ": "fennel",
    "सौंफ के दाने": "fennel seeds", "हींग": "asafoetida", "गरम मसाला पाउडर": "garam masala powder",
    "लाल मिर्च पाउडर": "red chilli powder", "काली मिर्च पाउडर": "black pepper powder",
    "पूरी काली मिर्च": "whole black peppercorns", "दाल चीनी": "cinnamon stick",
    "दालचीनी": "cinnamon stick", "राइ": "mustard seeds", "मेथी के दाने": "fenugreek seeds",
    "अदरक": "ginger", "लहसुन": "garlic", "हरा धनिया": "coriander leaves",
    "कढ़ी पत्ता": "curry leaves", "सफ़ेद उरद दाल": "white urad dal", "सफेद उरद दाल": "white urad dal",
    "अदरक लहसुन का पेस्ट": "ginger garlic paste", "निम्बू का रस": "lemon juice",
    "तेल": "cooking oil", "शक्कर": "sugar",
}
PROFILE_QUANTITY_PATTERN = r"^[\d\s./½¼¾⅓⅔-]+"
PROFILE_UNIT_PATTERN = r"\b(cups?|tablespoons?|tbsp|teaspoons?|tsp|grams?|kg|ml|litres?|liters?)\b"
APPROVED_CUISINES = [
    "indian", "north indian recipes", "south indian recipes", "bengali recipes",
    "maharashtrian recipes", "kerala recipes", "tamil nadu", "karnataka", "rajasthani", "andhra",
    "gujarati recipes", "goan recipes", "punjabi", "chettinad", "kashmiri", "mangalorean",
    "parsi recipes", "indo chinese", "awadhi", "oriya recipes", "sindhi", "konkan", "mughlai",
    "bihari", "hyderabadi", "assamese", "north east india recipes", "himachal", "udupi",
    "uttar pradesh", "coorg", "north karnataka", "coastal karnataka", "malabar", "lucknowi",
    "south karnataka", "malvani", "nagaland", "uttarakhand-north kumaon", "kongunadu", "haryana",
    "jharkhand",
]
PREPARATION_WORDS = [
    "finely chopped", "thinly sliced", "roughly chopped", "coarsely crushed", "freshly ground",
    "dry roasted", "deep fried", "shallow fried", "chopped", "sliced", "diced", "grated", "crushed",
    "minced", "shredded", "pureed", "mashed", "boiled", "cooked", "roasted", "soaked", "fried",
    "steamed", "blanched", "deseeded", "slit", "peeled", "beaten", "whisked", "melted", "toasted",
    "warm", "cold", "chilled", "sifted",
]
# Phrases that keep a preparation word in front, or at the end.
KEPT_AT_FRONT = ["green chilli", "red chilli", "dry red chilli"]
KEPT_AT_END = ["red chilli powder", "black pepper powder"]
CONTROLLED_PLURALS = {
    "onions": "onion", "tomatoes": "tomato", "potatoes": "potato", "chillies": "chilli",
    "chillis": "chilli", "chickpeas": "chickpea", "lentils": "lentil", "cloves": "clove",
    "leaves": "leaf", "seeds": "seed", "pods": "pod", "peppercorns": "peppercorn",
    "carrots": "carrot", "cucumbers": "cucumber", "mushrooms": "mushroom", "cashews": "cashew",
    "almonds": "almond", "walnuts": "walnut", "pistachios": "pistachio", "peanuts": "peanut",
    "raisins": "raisin", "apples": "apple", "bananas": "banana", "lemons": "lemon", "limes": "lime",
    "noodles": "noodle", "beans": "bean", "peas": "pea", "berries": "berry", "chilies": "chilli",
    "capsicums": "capsicum",
}
PROTECTED_PHRASES = [
    "green chilli", "red chilli", "dry red chilli", "chilli powder", "red chilli powder",
    "kashmiri red chilli", "black pepper", "white pepper", "bell pepper", "coriander powder",
    "coriander leaf", "coriander leaves", "coriander seed", "coriander seeds", "cumin seed",
    "cumin seeds", "cumin powder", "mustard seed", "mustard seeds", "mustard oil", "garam masala",
    "chaat masala", "chana masala", "sambar powder", "rasam powder", "coconut milk", "coconut oil",
    "dry coconut", "fresh coconut", "baking soda", "baking powder", "brown sugar", "powdered sugar",
]
GENERIC_QUALIFIERS = ["fresh", "raw", "organic"]
LEADING_RANGE = r"(?:(?:to|approx\.?|approximately|about|around)\s+)?"
LEADING_NUMBER = r"\d+(?:[-–/ ]\d+)*(?:\s*/\s*\d+)?(?:\.\d+)?"
TO_TASTE_PATTERN = r"(?i)\bto taste\b|\bas required\b|\bas needed\b|\bfor seasoning\b"
TO_TASTE_CUT = r"(?i)[-–—]|,\s*to taste|\bto taste\b|\bas required\b"

# ---------------------------------------------------------------- fixed values: diet and allergens
NON_VEG_PATTERNS = [
    r"\bchicken\b", r"\bmutton\b", r"\blamb\b", r"\bpork\b", r"\bbeef\b", r"\bveal\b", r"\bduck\b",
    r"\bturkey\b(?!(\s+berry|\s+chutney))", r"\bpoultry\b", r"\bkeema\b", r"\bkheema\b", r"\bgosht\b",
    r"\bmurgh\b", r"\bmurg\b", r"\bbacon\b", r"\bfish\b", r"\bfishes\b", r"\bprawn\b", r"\bprawns\b",
    r"\bshrimp\b", r"\bshrimps\b", r"\bcrab\b", r"\bcrabs\b", r"\blobster\b", r"\blobsters\b",
    r"\bseafood\b", r"\bsquid\b", r"\bsquids\b", r"\bcalamari\b", r"\bclam\b", r"\bclams\b",
    r"\boyster\b", r"\boysters\b", r"\banchov(?:y|ies)\b", r"\bpomfret\b", r"\bsalmon\b", r"\btuna\b",
    r"\bsardine\b", r"\bsardines\b", r"\bhilsa\b", r"\brohu\b", r"\bkatla\b", r"\bsurmai\b",
    r"\bmaach\b", r"\bmachh\b", r"\bmachli\b", r"\bbhetki\b", r"अंडे", r"अंडा", r"मछली", r"चिकन",
    r"मटन", r"गोश्त",
]
# (pattern, replacement), applied in this order to lower-cased text
CONTEXT_CLEANERS = [
    (r"\b(?:no|without|zero|free\s*from)\s+(?:onion\s*(?:and|&|or|,)?\s*|garlic\s*(?:and|&|or|,)?\s*)+", " "),
    (r"\b(?:onion|garlic|potato|root)\s*-\s*free\b|\b(?:onion|garlic|potato|root)\s+free\b", " "),
    (r"\b(?:no|without)\s+(?:potato|potatoes|carrot|carrots|beetroot|beetroots|radish|radishes|ginger|mushrooms?)\b", " "),
    (r"\b(?:no|without)\s+(?:eggs?|baida)\b|\b(?:egg|baida)[-\s]free\b|\beggless\b", " "),
    (r"\b(?:mock|plant[-\s]based|vegan|vegetarian|veg|soya|soy)\s+(?:scrambled\s+)?(?:chicken|meat|fish|mutton|prawn|prawns|beef|pork|duck|keema|kheema|eggs?|omelette|bacon)\b", " "),
    (r"\b(?:paneer|mushroom|matar|mutter|cabbage|broccoli)\s+(?:keema|kheema)\b", " "),
    (r"\b(?:meat|chicken|fish|mutton)\s+(?:masala|curry\s+masala|fry\s+masala|spice)(?:\s+(?:powder|mix|blend))?\b", " "),
    (r"\b(?:serve\s+with|side\s+dish\s+for|accompaniment\s+for|for)\s+(?:chicken|fish|mutton|meat|beef|prawns?)\b", " "),
    (r"\bcoffee\s+and\s+beef\b", " "),
    (r"\bchickens\s+togayal\b", "togayal"),
    (r"\bturkey\s+chutney\b", "chutney"),
]
EGGPLANT_WORDS = ["eggplant", "egg plant", "egg-plant"]
EGGPLANT_PATTERN = r"\begg[-\s]?plants?\b"
EGGPLANT_OVERRIDES = ["chicken", "mutton", "fish", "meat", "prawn", "beef", "pork"]
# (reported term, pattern, phrases that excuse it)
GUARDED_NON_VEG = [
    ("egg", r"\b(?:eggs?|baida)\b", ["eggplant", "egg plant", "egg-plant", "eggless", "egg replacer", "egg-free", "egg free"]),
    ("meat", r"\bmeat\b", ["coconut meat", "meat masala", "sweetmeat", "soya meat", "soy meat", "mock meat"]),
    ("ham", r"\bham\b", ["graham", "chamomile", "khaman"]),
]
PLANT_EXCEPTIONS = {
    "milk": ["coconut milk", "almond milk", "soy milk", "soya milk", "oat milk", "cashew milk"],
    "butter": ["peanut butter", "cocoa butter", "apple butter", "shea butter"],
    "cream": ["coconut cream", "almond cream", "soy cream"],
}
NON_VEGAN_NAMES = ["milk", "curd", "yogurt", "paneer", "ghee", "butter", "cheese", "cream", "honey", "egg", "chicken"]
DAIRY_NAMES = ["milk", "curd", "yogurt", "paneer", "ghee", "butter", "cheese", "cream"]
JAIN_PROHIBITED = [
    "onion", "garlic", "potato", "carrot", "radish", "beetroot", "ginger", "turmeric fresh",
    "sweet potato", "yam", "taro", "colocasia", "turnip", "shallot", "scallion", "spring onion",
    "leek", "chives",
]
SATVIK_PROHIBITED = [
    "onion", "garlic", "shallot", "scallion", "spring onion", "leek", "mushroom", "alcohol", "wine", "beer",
]
EXPLICIT_NON_VEG_LABELS = [
    "non vegetarian", "non vegeterian", "non-vegetarian", "non-vegeterian", "non veg", "non-veg", "eggetarian",
]
FLAG_EXEMPT_LABELS = ["sattvic", "satvik", "no onion no garlic", "vegan"]
NON_VEGETARIAN_NAMES = [
    "chicken", "mutton", "fish", "prawn", "prawns", "shrimp", "shrimps", "crab", "crabs", "lobster",
    "egg", "eggs", "meat", "pork", "beef", "lamb", "bacon", "ham", "seafood", "squid", "keema",
    "kheema", "gosht", "maach", "machh", "machli", "murgh", "murg", "baida",
]
NON_VEGAN_CATEGORIES = ["dairy", "meat", "egg"]
ALLERGEN_BY_CATEGORY = {"dairy": "dairy", "egg": "egg", "nut": "tree_nut", "soy": "soy"}
ALLERGEN_BY_NAME = {
    "peanut": "peanut", "almond": "tree_nut", "cashew": "tree_nut", "walnut": "tree_nut",
    "pistachio": "tree_nut", "wheat": "gluten", "maida": "gluten", "semolina": "gluten",
    "rava": "gluten", "sooji": "gluten", "mustard": "mustard", "sesame": "sesame", "soy": "soy",
}
ALLERGEN_TEXT_WORDS = {
    "peanut": ["peanut"], "peanuts": ["peanut"],
    "tree_nut": ["cashew", "almond", "walnut", "pistachio", "pista", "badam", "kaju"],
    "tree_nuts": ["cashew", "almond", "walnut", "pistachio", "pista", "badam", "kaju"],
    "nuts": ["cashew", "almond", "walnut", "pistachio", "pista", "badam", "kaju"],
    "gluten": ["wheat", "maida", "sooji", "semolina", "rava", "atta"],
}
DEFAULT_UNIT_BY_CATEGORY = {
    "spice": "tsp", "herb": "sprig", "dairy": "ml", "oil": "tbsp", "liquid": "ml",
    "vegetable": "piece", "fruit": "piece", "grain": "g", "pulse": "g", "flour": "g", "nut": "g",
    "sweetener": "tsp", "meat": "g",
}

# ---------------------------------------------------------------- fixed values: aliases and mapping
NON_ALIAS_DESCRIPTORS = [
    "raw", "ripe", "over ripe", "split", "whole", "fresh", "unsalted", "white", "small", "medium",
    "large", "big", "tender", "optional", "adjust to taste", "adjust", "as required", "as needed",
    "for garnish", "garnish", "taste", "chopped", "finely chopped", "sliced", "diced", "grated",
    "peeled", "crushed", "minced", "boiled", "cooked", "roasted", "fried", "washed", "deseeded",
    "shredded", "mashed", "dry", "extra", "thick", "thin", "torn roughly",
]
MAPPING_FORMS = [
    "default", "powder", "seed", "leaf", "whole", "pod", "stick", "paste", "fresh", "dried",
    "flakes", "flour", "milk", "oil", "hung", "caster", "raw", "roasted", "ripe", "basmati",
    "breast", "strand", "puree", "active dry", "kabuli", "desiccated", "white",
]
MAPPING_CORRECTIONS = {
    "coconutfresh": ("coconut", "fresh"), "cinnamonstick": ("cinnamon", "stick"),
    "all purpose flourflour": ("all purpose flour", "flour"),
    "whole wheat flourflour": ("whole wheat flour", "flour"),
    "chickpea flourflour": ("chickpea flour", "flour"), "cornflour": ("corn", "flour"),
    "riceflour": ("rice", "flour"), "urad dalwhite": ("urad dal", "white"),
    "black pepperwhole": ("black pepper", "whole"), "ginger garlicpaste": ("ginger garlic", "paste"),
    "red chillidried": ("red chilli", "dried"), "green peasfresh": ("green peas", "fresh"),
    "creamfresh": ("cream", "fresh"), "tomatopuree": ("tomato", "puree"),
    "fenugreekseed": ("fenugreek", "seed"), "mustard oil": ("mustard", "oil"),
    "sesame oil": ("sesame", "oil"),
}
CATEGORY_OF_NAME = {
    "turmeric": "spice", "cumin": "spice", "coriander": "spice", "mustard": "spice",
    "fennel": "spice", "fenugreek": "spice", "asafoetida": "spice", "black pepper": "spice",
    "cardamom": "spice", "cinnamon": "spice", "red chilli": "spice", "kashmiri red chilli": "spice",
    "garam masala": "spice", "chaat masala": "spice", "sambar powder": "spice", "ajwain": "spice",
    "star anise": "spice", "paprika": "spice", "saffron": "spice", "nutmeg": "spice",
    "mace": "spice", "kalonji": "spice", "anardana": "spice", "kokum": "spice", "amchur": "spice",
    "panch phoran masala": "spice", "italian seasoning": "spice", "salt": "seasoning",
    "black salt": "seasoning", "onion": "vegetable", "tomato": "vegetable", "potato": "vegetable",
    "carrot": "vegetable", "green bell pepper": "vegetable", "red bell pepper": "vegetable",
    "yellow bell pepper": "vegetable", "green beans": "vegetable", "green peas": "vegetable",
    "cabbage": "vegetable", "spinach": "vegetable", "broccoli": "vegetable",
    "cauliflower": "vegetable", "cucumber": "vegetable", "brinjal": "vegetable",
    "pumpkin": "vegetable", "beetroot": "vegetable", "bottle gourd": "vegetable",
    "bitter gourd": "vegetable", "radish": "vegetable", "bhindi": "vegetable",
    "drumstick": "vegetable", "zucchini": "vegetable", "capsicum": "vegetable",
    "spring onion": "vegetable", "shallot": "vegetable", "shallots": "vegetable",
    "sweet potato": "vegetable", "garlic": "vegetable", "ginger": "root", "lemon": "fruit",
    "lemon juice": "fruit", "mango": "fruit", "banana": "fruit", "apple": "fruit",
    "pineapple": "fruit", "strawberries": "fruit", "orange": "fruit", "date": "fruit",
    "raisin": "dried fruit", "mint leaf": "herb", "curry leaf": "herb",
    "basil": "herb", "fenugreek leaves": "herb", "oregano": "herb", "rosemary": "herb",
    "thyme": "herb", "dill": "herb", "parsley": "herb", "milk": "dairy", "curd": "dairy",
    "ghee": "dairy", "butter": "dairy", "cream": "dairy", "paneer": "dairy", "cheese": "dairy",
    "mozzarella": "dairy", "parmesan": "dairy", "cheddar": "dairy", "feta": "dairy",
    "khoya": "dairy", "buttermilk": "dairy", "condensed milk": "dairy", "cream cheese": "dairy",
    "sunflower oil": "oil", "olive oil": "oil", "cooking oil": "oil", "coconut oil": "oil",
    "mustard oil": "oil", "sesame oil": "oil", "toor dal": "pulse", "chana dal": "pulse",
    "moong dal": "pulse", "urad dal": "pulse", "masoor dal": "pulse", "rajma": "pulse",
    "chickpea": "pulse", "kala chana": "pulse", "green moong dal": "pulse", "rice": "grain",
    "semolina": "grain", "poha": "grain", "ragi": "grain", "all purpose flour": "flour",
    "whole wheat flour": "flour", "chickpea flour": "flour", "ragi flour": "flour",
    "cashew": "nut", "almond": "nut", "pistachio": "nut", "walnut": "nut", "peanut": "nut",
    "sesame": "seed", "poppy": "seed", "chia": "seed", "chicken": "meat", "mutton": "meat",
    "prawns": "seafood", "egg": "egg", "tofu": "soy", "soy sauce": "condiment",
    "vinegar": "condiment", "tamarind": "condiment", "sugar": "sweetener",
    "brown sugar": "sweetener", "jaggery": "sweetener", "honey": "sweetener",
    "baking powder": "baking", "baking soda": "baking", "yeast": "baking", "vanilla": "flavoring",
    "cocoa": "baking", "water": "liquid", "ginger garlic": "paste",
}
# (name, form or None for any form, category); the first match wins over CATEGORY_OF_NAME
CATEGORY_OF_FORM = [
    ("coconut", "oil", "oil"), ("coconut", "milk", "dairy"), ("coconut", None, "fruit"),
    ("sesame", "oil", "oil"), ("coriander", "seed", "spice"), ("coriander", "powder", "spice"),
    ("coriander", "leaf", "herb"), ("mustard", "oil", "oil"), ("corn", "flour", "flour"),
    ("rice", "flour", "flour"),
]
DISPLAY_NAMES = {
    ("cumin", "seed"): "Cumin Seeds", ("cumin", "powder"): "Cumin Powder",
    ("coriander", "seed"): "Coriander Seeds", ("coriander", "powder"): "Coriander Powder",
    ("coriander", "leaf"): "Coriander Leaves", ("mustard", "seed"): "Mustard Seeds",
    ("mustard", "oil"): "Mustard Oil", ("fennel", "seed"): "Fennel Seeds",
    ("fenugreek", "seed"): "Fenugreek Seeds", ("black pepper", "powder"): "Black Pepper Powder",
    ("black pepper", "whole"): "Whole Black Peppercorns", ("turmeric", "powder"): "Turmeric Powder",
    ("red chilli", "powder"): "Red Chilli Powder", ("red chilli", "flakes"): "Red Chilli Flakes",
    ("red chilli", "dried"): "Dry Red Chilli", ("coconut", "fresh"): "Fresh Coconut",
    ("coconut", "milk"): "Coconut Milk", ("coconut", "oil"): "Coconut Oil",
    ("coconut", "desiccated"): "Desiccated Coconut", ("cardamom", "powder"): "Cardamom Powder",
    ("cardamom", "pod"): "Cardamom Pods", ("cinnamon", "stick"): "Cinnamon Stick",
    ("cinnamon", "powder"): "Cinnamon Powder", ("garam masala", "powder"): "Garam Masala Powder",
    ("ginger garlic", "paste"): "Ginger Garlic Paste", ("urad dal", "white"): "White Urad Dal",
    ("green peas", "fresh"): "Fresh Green Peas", ("cream", "fresh"): "Fresh Cream",
    ("tomato", "puree"): "Tomato Puree", ("peanut", "raw"): "Raw Peanuts",
    ("peanut", "roasted"): "Roasted Peanuts", ("banana", "ripe"): "Ripe Banana",
    ("chicken", "breast"): "Chicken Breast", ("egg", "whole"): "Whole Egg",
    ("saffron", "strand"): "Saffron Strands", ("olive oil", "default"): "Olive Oil",
    ("all purpose flour", "flour"): "All Purpose Flour",
    ("whole wheat flour", "flour"): "Whole Wheat Flour",
    ("chickpea flour", "flour"): "Chickpea Flour", ("rice", "flour"): "Rice Flour",
    ("corn", "flour"): "Corn Flour", ("kashmiri red chilli", "powder"): "Kashmiri Red Chilli Powder",
    ("chaat masala", "powder"): "Chaat Masala Powder", ("corn", "default"): "Corn",
    ("sesame", "seed"): "Sesame Seeds", ("sesame", "oil"): "Sesame Oil",
}

# ---------------------------------------------------------------- fixed values: food candidates
FOOD_TOKEN_SYNONYMS = {
    "tomatoes": "tomato", "potatoes": "potato", "onions": "onion", "leaves": "leaf",
    "seeds": "seed", "beans": "bean", "peas": "pea", "spices": "spice", "chilli": "chili",
    "chillies": "chili", "chile": "chili", "chiles": "chili", "berries": "berry", "moong": "mung",
    "almonds": "almond", "peppers": "pepper", "mushrooms": "mushroom", "carrots": "carrot",
    "apples": "apple", "bananas": "banana", "lemons": "lemon", "mangos": "mango",
    "mangoes": "mango", "eggs": "egg", "noodles": "noodle", "crackers": "cracker",
    "flakes": "flake", "peppercorns": "peppercorn", "grains": "grain", "nuts": "nut",
    "chickpeas": "chickpea",
}
MATCH_STOPWORDS = ["dal", "year", "round", "average", "style", "type", "stages"]
COMPOSITE_PREFIXES = [
    "bagel", "bagels", "beverage", "beverages", "plant-based beverage", "carbonated drink",
    "soft drink", "drink", "drinks", "milkshake", "milkshakes", "frozen entree", "bar", "bars",
    "pizza", "pasta", "noodles", "soup", "soups", "sandwich", "bread", "cookie", "cookies",
    "cracker", "crackers", "cake", "cakes", "cereal, ready to eat", "cereal, infant",
    "rice, cheese", "rice crackers", "rice, spanish", "rice mix", "rice and vermicelli mix",
    "snack", "snacks", "fast food", "salad", "sauce", "sauces", "pie", "dessert", "desserts",
    "candy", "candies", "babyfood", "baby food", "entree", "entrees", "meal", "meals", "tortilla",
    "tortillas", "dulce de leche", "margarine", "margarine-like spread",
]
BROAD_SEGMENTS = [
    "nut", "nuts", "grain", "grains", "spice", "spices", "bean", "beans", "legume", "legumes", "pea", "peas", "vegetable",
    "vegetables", "fruit", "fruits", "seed", "seeds", "fat", "fats", "oil", "oils", "cereal",
    "cereals", "candy", "candies", "beverage", "beverages", "poultry", "meat", "finfish",
    "shellfish", "dairy", "soup", "sauce", "babyfood", "snack", "snacks", "dessert",
]
DERIVED_FOOD_WORDS = [
    "butter", "meal", "paste", "powder", "powdered", "flour", "noodles", "noodle", "cereal",
    "cereals", "crackers", "cracker", "chips", "chip", "ketchup", "catsup", "puree", "sauce",
    "sauces", "juice", "juices", "oil", "oils", "syrup", "syrups", "milk", "extract", "flakes",
    "flake", "dehydrated", "dried", "dry", "mix", "sprouted", "sprouts",
]
FORM_SYNONYMS = {
    "powder": ["powder", "powdered", "ground"], "seed": ["seed", "seeds"], "leaf": ["leaf", "leaves"],
    "dried": ["dry", "dried", "dehydrated"], "dry": ["dry", "dried", "dehydrated"], "oil": ["oil"],
    "flour": ["flour"], "fresh": ["fresh"], "white": ["white"], "basmati": ["basmati"],
    "whole": ["whole"], "paste": ["paste"], "kabuli": ["kabuli", "garbanzo"], "ripe": ["ripe"],
    "roasted": ["roasted"], "flakes": ["flake", "flakes"], "pod": ["pod", "pods"],
    "stick": ["stick", "sticks"], "strand": ["strand", "strands"], "puree": ["puree"],
    "juice": ["juice"], "sauce": ["sauce"], "desiccated": ["desiccated"], "hung": ["hung"],
    "caster": ["caster"], "active dry": ["active", "dry"], "red": ["red"], "green": ["green"],
    "orange": ["orange"], "yellow": ["yellow"],
}
NAME_FORM_TERMS = [
    "raw", "cooked", "boiled", "dry", "dried", "dehydrated", "powder", "powdered", "ground", "seed",
    "seeds", "leaf", "leaves", "oil", "flour", "paste", "whole", "white", "brown", "basmati",
    "wild", "glutinous", "parboiled", "regular", "long grain", "medium grain", "short grain",
    "green", "orange", "yellow", "fresh", "roasted", "fried", "flakes", "pod", "pods", "stick",
    "sticks", "split", "mature", "skim", "salted", "unsalted", "instant", "puree", "juice", "sauce",
    "desiccated", "ketchup", "catsup", "buttermilk", "sweetened", "chocolate", "condensed",
    "evaporated", "fortified", "pasteurized", "homogenized", "human", "goat", "sheep",
    "strawberry", "flavoured", "flavored",
]
DEFAULT_FORM_PENALTY = [
    "powder", "powdered", "ground", "seed", "seeds", "leaf", "leaves", "oil", "flour", "paste",
    "whole", "white", "brown", "basmati", "fresh", "flakes", "pod", "pods", "puree", "juice",
    "sauce", "desiccated", "green", "orange", "yellow", "chocolate", "goat", "sheep", "human",
    "coconut", "buttermilk", "condensed", "sweetened", "skim", "pasteurized", "homogenized",
    "canned", "fortified", "strawberry", "flavoured", "flavored",
]
SPECIAL_GRAIN_FORMS = ["brown", "glutinous", "wild", "parboiled", "instant", "basmati"]
REGULAR_GRAIN_FORMS = ["regular", "long grain"]
EVIDENCE_PATTERNS = {
    "raw": r"(?i)\b(?:raw|uncooked)\b", "dry": r"(?i)\b(?:dry|dried|dehydrated)\b",
    "cooked": r"(?i)\b(?:cooked|prepared|steamed|fried|roasted)\b", "boiled": r"(?i)\bboiled\b",
}
METHOD_PRIORITY = {"EXACT_NAME": 0, "ALIAS_MATCH": 1, "FORM_MATCH": 2, "TOKEN_MATCH": 3, "FUZZY_CANDIDATE": 4}
STATE_FORMS = ["raw", "dry", "dried", "dehydrated", "boiled", "cooked", "fried", "roasted", "steamed", "baked"]
MIN_COVERAGE = 0.65
COVERAGE_WEIGHT = 0.55
JACCARD_WEIGHT = 0.45
MIN_TOKEN_SCORE = 0.35
MIN_FUZZY_SCORE = 0.72
FUZZY_FILL = 3
FUZZY_MIN_LETTERS = 6
MAX_FOOD_CANDIDATES = 10
FORM_MATCH_BONUS = 0.04
FORM_CONFLICT_PENALTY = 0.12

# ---------------------------------------------------------------- fixed values: validation
ALIAS_STATUSES = ["AUTO", "VALIDATED", "REVIEW_REQUIRED", "REJECTED"]
NUTRITION_TIERS = ["COMPLETE", "PARTIAL", "APPROXIMATE"]
CURATION_STATUSES = ["APPROVED", "NEEDS_REVIEW", "NO_MATCH"]
TRUE_WORDS = ["true", "1", "yes", "t"]
DISCRETE_TARGETS = (
    r"(?i)\b(peppercorn|peppercorns|pepper|almond|almonds|cashew|cashews|pistachio|pistachios|tomato|tomatoes|"
    r"onion|onions|chilli|chillies|chili|chilies|garlic|ginger|cinnamon|bay\s*leaf|bay\s*leaves|clove|cloves|"
    r"cardamom|cardamoms|date|dates|raisin|raisins)\b"
)
UNSAFE_MEASURE = (
    r"(?i)\b(100\s*ml|100\s*ml\s*whole|100\s*ml\s*packed|125\s*ml\s*packed|250\s*ml\s*packed|container|individual\s*container)\b"
)
UNSAFE_NOTE = (
    r"(?i)\b(?:100\s*ml\s*whole|100\s*ml\s*packed|100\s*ml\s*container|125\s*ml\s*packed|250\s*ml\s*packed)\b"
)

# ---------------------------------------------------------------- fixed values: scoring and feedback
HYBRID_WEIGHTS = {"similarity": 0.40, "ingredient": 0.25, "nutrition": 0.20, "preference": 0.15}
INGREDIENT_REPEAT = 3
MIN_DOC_FREQ = 2
PERSONAL_GAINS = {
    "cuisine_affinity": 0.20, "region_affinity": 0.10, "meal_type_affinity": 0.10, "category_affinity": 0.10,
    "pantry_overlap_ratio": 0.25, "past_liked": 0.30, "past_saved": 0.25, "past_cooked": 0.20,
    "nutrition_target_alignment": 0.15,
}
PERSONAL_LOSSES = {"disliked_ingredient_penalty": 0.40, "past_disliked": 0.50, "past_hidden": 1.00, "recently_recommended": 0.15}
PREFERRED_GAIN, PREFERRED_STEP, PREFERRED_CAP = 0.15, 0.1, 0.3
PERSONAL_WEIGHT = 0.20
RECENT_LIMIT = 30
GRADES = {"COOKED": 3, "SAVE": 2, "LIKE": 2, "IMPRESSION": 1, "DISLIKE": 0, "HIDE": 0}
PRECEDENCE = ["HIDE", "DISLIKE", "COOKED", "SAVE", "LIKE", "IMPRESSION"]
KNOWN_FEEDBACK = ["COOKED", "SAVE", "LIKE", "DISLIKE", "HIDE", "NONE", ""]
SUFFICIENCY = {
    "total_interactions": 200, "unique_users": 20, "unique_recipes": 50, "unique_queries": 30,
    "positive_labels": 40, "negative_labels": 10, "days_of_data": 7,
}
GATES = {
    "max_violations": 0, "min_ndcg5_pct": 0.0, "min_mrr10_pct": 0.0, "max_zero_result_pct": 0.0, "max_p95_ms": 250.0,
}
FEATURE_NAMES = [
    "retrieval_tfidf_score", "retrieval_bge_score", "retrieval_tfidf_rr", "retrieval_bge_rr",
    "retrieval_both", "ingredient_match_count", "ingredient_total_count",
    "ingredient_coverage_ratio", "pantry_coverage_ratio", "required_ingredient_count",
    "preferred_ingredient_count", "canonical_match_count", "calorie_target_distance",
    "protein_target_distance", "per_serving_calories", "per_serving_protein_g",
    "per_serving_carbs_g", "per_serving_fat_g", "per_serving_fiber_g", "nutrition_available",
    "vegetarian_compliant", "vegan_compliant", "jain_compliant", "satvik_compliant",
    "cuisine_match", "region_match", "meal_type_match", "category_match", "total_time_min",
    "hard_constraint_violation",
]

# ---------------------------------------------------------------- fixed values: nutrition tables
# canonical name -> grams per counted item
ITEM_GRAMS = {
    "almond": 1.2, "cashew": 1.5, "walnut": 3.0, "onion": 110.0, "tomato": 123.0, "lemon": 58.0,
    "lime": 44.0, "egg": 50.0, "garlic": 3.0, "black pepper": 0.05, "peppercorn": 0.05,
}
# canonical name|unit -> grams per unit
MEASURE_OVERRIDES = {
    "ghee|tbsp": 12.8, "ghee|tablespoon": 12.8, "ghee|tsp": 4.27, "ghee|teaspoon": 4.27, "ghee|cup": 205.0,
    "ghee|ml": 0.905, "ghee|liter": 905.0, "butter|tbsp": 14.2, "butter|tablespoon": 14.2, "butter|tsp": 4.73,
    "butter|teaspoon": 4.73, "oil|tbsp": 13.82, "oil|tablespoon": 13.82, "oil|tsp": 4.607, "oil|teaspoon": 4.607,
    "cream|tbsp": 15.22, "cream|tablespoon": 15.22, "cream|tsp": 5.07, "cream|teaspoon": 5.07,
    "ginger|inch": 5.0, "cinnamon|inch": 1.3,
}
# canonical name|state -> factor to the raw mass; states listed without a factor need review
YIELD_FACTORS = {
    "rice|cooked": 0.38, "rice|boiled": 0.38, "rice|steamed": 0.38, "rice|soaked": 0.77,
    "moong dal|cooked": 0.385, "moong dal|boiled": 0.385, "moong dal|steamed": 0.385, "moong dal|soaked": 0.55,
    "toor dal|cooked": 0.385, "toor dal|boiled": 0.385, "toor dal|steamed": 0.385, "toor dal|soaked": 0.55,
    "chickpea|cooked": 0.42, "chickpea|boiled": 0.42, "chickpea|soaked": 0.52, "potato|boiled": 1.00,
    "potato|cooked": 1.00, "potato|steamed": 1.00, "green peas|boiled": 1.00, "green peas|steamed": 1.00,
    "green peas|cooked": 1.00,
}
# (pattern, class, default quantity, default unit) in the order in which they are tried
QUALITATIVE_RULES = [
    ("salt", "ZERO_CALORIE_QUALITATIVE", None, None), ("black salt", "ZERO_CALORIE_QUALITATIVE", None, None),
    ("rock salt", "ZERO_CALORIE_QUALITATIVE", None, None), ("water", "ZERO_CALORIE_QUALITATIVE", None, None),
    ("sunflower oil", "ESTIMABLE_QUALITATIVE", 1.0, "tbsp"), ("oil", "ESTIMABLE_QUALITATIVE", 1.0, "tbsp"),
    ("ghee", "ESTIMABLE_QUALITATIVE", 1.0, "tbsp"), ("butter", "ESTIMABLE_QUALITATIVE", 1.0, "tbsp"),
    ("mustard oil", "ESTIMABLE_QUALITATIVE", 1.0, "tbsp"), ("sesame oil", "ESTIMABLE_QUALITATIVE", 1.0, "tbsp"),
    ("olive oil", "ESTIMABLE_QUALITATIVE", 1.0, "tbsp"), ("sugar", "UNAVAILABLE_QUALITATIVE", None, None),
    ("flour", "UNAVAILABLE_QUALITATIVE", None, None), ("maida", "UNAVAILABLE_QUALITATIVE", None, None),
    ("besan", "UNAVAILABLE_QUALITATIVE", None, None), ("coriander", "UNAVAILABLE_QUALITATIVE", None, None),
    ("mint", "UNAVAILABLE_QUALITATIVE", None, None), ("curry leaves", "UNAVAILABLE_QUALITATIVE", None, None),
]
# (text pattern, ingredient word, written unit, meant unit)
UNIT_CORRECTIONS = [
    (r"(?i)750\s*kg\b", "chicken", "kg", "g"), (r"(?i)200\s*(?:liter|l)\b", "coconut milk", "liter", "ml"),
    (r"(?i)250\s*kg\b", "watermelon", "kg", "g"),
]
