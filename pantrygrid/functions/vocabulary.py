"""The words that restrictions stand for, the sections of the catalogue that belong to them, and their other names."""

from __future__ import annotations

SWEETS = [
    "candy", "candies", "chocolate", "cookie", "cookies", "biscuit", "cake", "cakes", "cupcake", "brownie", "brownies", "pie", "pies", "pastry", "pastries", "doughnut", "doughnuts", "donut", "donuts",
    "muffin", "muffins", "danish", "eclair", "tart", "tarts", "ice cream", "sherbet", "sorbet", "pudding", "custard", "mousse", "syrup", "jam", "jelly", "marmalade", "honey", "caramel", "fudge",
    "marshmallow", "marshmallows", "sweet roll", "sweet rolls", "frosting", "icing", "dessert", "desserts", "gelatin", "cheesecake", "cobbler", "turnover", "strudel", "baklava",
]
FLOUR = [
    "bread", "breads", "roll", "rolls", "bun", "buns", "bagel", "bagels", "biscuit", "biscuits", "croissant", "croissants", "muffin", "muffins", "pancake", "pancakes", "waffle", "waffles", "crepe", "crepes",
    "tortilla", "tortillas", "pita", "cracker", "crackers", "doughnut", "doughnuts", "donut", "donuts", "pastry", "pastries", "cake", "cakes", "pie", "pies", "toast", "crouton", "croutons",
    "breadstick", "breadsticks", "dumpling", "dumplings", "pizza", "breaded", "breading", "batter", "battered", "flour", "dough",
]
LACTOSE = ["milk", "cheese", "yogurt", "yoghurt", "cream", "butter", "ice cream", "whey", "custard", "kefir", "ricotta", "mozzarella", "cheddar", "parmesan", "latte", "milkshake", "dairy"]
GLUTEN = [
    "wheat", "bread", "breads", "pasta", "spaghetti", "macaroni", "noodle", "noodles", "barley", "rye", "couscous", "cracker", "crackers", "cake", "cakes", "cookie", "cookies", "pastry",
    "pastries", "tortilla", "tortillas", "pancake", "pancakes", "waffle", "waffles", "bagel", "bagels", "muffin", "muffins", "pizza", "dumpling", "dumplings", "breaded",
    "seitan", "bulgur", "semolina", "farina", "spelt", "graham", "panko", "orzo", "lasagna", "ravioli", "tortellini", "gnocchi", "ramen", "udon", "wonton", "wontons", "egg roll", "egg rolls", "potsticker", "potstickers",
    "biscuit", "biscuits", "croissant", "croissants", "doughnut", "doughnuts", "donut", "donuts", "bun", "buns", "pita", "crepe", "crepes", "pie crust", "pretzel", "pretzels", "crouton", "croutons", "breadstick", "breadsticks",
    "breading", "batter", "battered", "stuffing", "ice cream cone", "chicken nugget", "chicken nuggets", "kiev", "malt", "malted", "beer", "coffee substitute", "cereal grain beverage", "milky way",
    "gravy", "cream of mushroom", "cheese sauce prepared recipe", "soy sauce", "teriyaki", "hoisin", "lo mein", "chow mein", "fried rice", "hot and sour soup", "surimi", "vermicelli mix", "crunch coating",
]
VEGETARIAN = [
    "beef", "pork", "chicken", "turkey", "lamb", "veal", "duck", "goose", "bacon", "ham", "sausage", "salami", "pepperoni", "meat", "meatball", "meatballs", "meatloaf", "steak", "brisket",
    "liver", "gizzard", "fish", "salmon", "tuna", "cod", "tilapia", "trout", "sardine", "sardines", "anchovy", "anchovies", "herring", "shrimp", "crab", "lobster", "clam", "clams", "oyster", "oysters",
    "mussel", "mussels", "squid", "octopus", "scallop", "scallops", "seafood", "gelatin",
]
FRIED = ["fried", "deep-fried", "deep fried", "batter-fried", "tempura", "french fries", "hash brown", "hash browns", "fritter", "fritters", "doughnut", "doughnuts", "donut", "donuts"]
ALCOHOL = ["beer", "wine", "vodka", "whiskey", "whisky", "rum", "liqueur", "brandy", "cocktail", "cocktails", "ale", "hard cider", "champagne"]
NUTS = ["nut", "nuts", "peanut", "peanuts", "almond", "almonds", "walnut", "walnuts", "cashew", "cashews", "pistachio", "pistachios", "pecan", "pecans", "hazelnut", "hazelnuts", "macadamia", "praline"]
SEAFOOD = [
    "fish", "salmon", "tuna", "cod", "tilapia", "trout", "sardine", "sardines", "anchovy", "anchovies", "herring", "mackerel", "halibut", "shrimp", "crab", "lobster", "clam", "clams", "oyster", "oysters",
    "mussel", "mussels", "squid", "octopus", "scallop", "scallops", "seafood", "caviar", "shark", "eel",
]
EGGS = ["egg", "eggs", "omelet", "omelette", "frittata", "quiche", "meringue", "mayonnaise"]
SUGAR = ["sugar", "sugars", "sweetened", "syrup", "candy", "candies", "soda", "cola", "soft drink"]
PORK = [
    "pork", "ham", "hams", "bacon", "hog", "hogs", "pig", "pigs", "lard", "prosciutto", "pancetta", "salami", "pepperoni", "chorizo", "kielbasa", "bratwurst", "mortadella", "chitterlings", "cracklings",
    "scrapple", "spareribs", "pupusas del cerdo", "boar", "pizza meat topping",
]
#: Diets are made of the groups above.
NO_MEAT = sorted({*VEGETARIAN, *PORK})
GROUPS = {
    "sweets": SWEETS, "flour": FLOUR, "lactose": LACTOSE, "gluten": GLUTEN, "vegetarian": NO_MEAT, "vegan": sorted({*NO_MEAT, *LACTOSE, *EGGS, "honey"}), "fried": FRIED, "alcohol": ALCOHOL,
    "nuts": NUTS, "seafood": SEAFOOD, "eggs": EGGS, "sugar": SUGAR, "pork": PORK, "halal": sorted({*PORK, *ALCOHOL}),
}
SECTIONS = {
    "sweets": ["cookies", "cakes and pies", "doughnut", "candy", "ice cream", "pudding", "gelatins, ices", "cereal bars", "higher sugar", "sugars and", "jams", "syrup", "frozen dairy", "sweet roll", "milk shakes", "smoothies"],
    "flour": ["bread", "rolls and buns", "bagels", "biscuits", "muffins", "pancakes", "cracker", "tortilla", "pizza", "pasta", "grain-based", "cookies", "cakes and pies", "doughnut", "sandwich", "burger", "burritos", "pretzel", "dumplings", "macaroni", "noodles"],
    "lactose": ["cheese", "milk", "yogurt", "ice cream", "frozen dairy", "dairy drinks", "cream-based", "butter"],
    "gluten": ["bread", "rolls and buns", "bagels", "biscuits", "muffins", "pancakes", "cracker", "tortillas", "pizza", "pasta mixed", "grain-based", "cookies", "cakes and pies", "doughnut", "sandwich", "burger", "burritos", "pretzel", "macaroni"],
    "vegetarian": ["meat", "poultry", "chicken", "turkey", "beef", "pork", "lamb", "bacon", "sausage", "fish", "seafood", "shellfish", "cold cuts", "frankfurter", "burgers", "liver and organ"],
    "fried": ["fried", "french fries", "chicken patties", "doughnut"], "nuts": ["nuts and seeds", "peanut butter"], "seafood": ["fish", "seafood", "shellfish"], "eggs": ["eggs and omelets", "egg/breakfast", "egg rolls"],
    "sugar": ["candy", "soft drinks", "fruit drinks", "sport and energy", "higher sugar", "sugars and", "syrup", "jams"], "alcohol": ["alcoholic", "beer", "wine", "liquor"],
}
SECTIONS["vegan"] = sorted({*SECTIONS["vegetarian"], *SECTIONS["lactose"], *SECTIONS["eggs"]})
OTHER_NAMES = {
    "sweet": "sweets", "candy": "sweets", "desserts": "sweets", "dessert": "sweets", "sugary": "sweets", "flour products": "flour", "baked goods": "flour", "bakery": "flour", "pastry": "flour", "bread products": "flour",
    "dairy": "lactose", "milk products": "lactose", "lactose-free": "lactose", "meat": "vegetarian", "no meat": "vegetarian", "frying": "fried", "deep-fried": "fried", "nut": "nuts", "tree nuts": "nuts", "fish": "seafood", "shellfish": "seafood", "egg": "eggs",
    "pork products": "pork", "swine": "pork", "pig meat": "pork", "celiac": "gluten", "coeliac": "gluten", "celiac disease": "gluten", "gluten-free": "gluten", "gluten free": "gluten", "no gluten": "gluten", "without gluten": "gluten", "wheat allergy": "gluten",
    "dairy-free": "lactose", "dairy free": "lactose", "milk allergy": "lactose", "lactose intolerance": "lactose", "no dairy": "lactose", "nut allergy": "nuts", "tree nut allergy": "nuts", "peanut allergy": "peanut", "egg allergy": "eggs", "fish allergy": "seafood", "shellfish allergy": "seafood",
    "no pork": "pork", "vegetarian diet": "vegetarian", "vegan diet": "vegan", "no alcohol": "alcohol", "alcohol-free": "alcohol",
}
#: Diets that a wish may name, and what other names of groups say that a food is left out.
DIETS, LEFT_OUT = {"halal", "vegan", "vegetarian"}, r"free\b|^no\s|^without\s|allergy|intolerance|celiac|coeliac|\bdiet$"
#: What is not left out but must be said, by group: pattern of a part, its name.
CAUTIONS = [({"gluten"}, r"\boats?\b|\boatmeal\b|\bgranola\b|\bmuesli\b", "овёс"), ({"pork", "halal"}, r"\bgelatin", "желатин")]
