"""Word lists, patterns and centres that results depend on."""

# --- Fixed values. Question word -> labels it may mean. A plural not listed
# --- falls back to its singular (strip "s", then "es").
LABEL_WORDS = {
    "car": ["car", "suv", "van"],
    "automobile": ["car", "suv", "van"],
    "bus": ["bus"],
    "truck": ["truck", "semi-truck"],
    "semi": ["semi-truck", "truck"],
    "suv": ["suv", "car"],
    "van": ["van", "car"],
    "vehicle": ["car", "bus", "truck", "suv", "van", "semi-truck", "motorcycle"],
    "motorcycle": ["motorcycle"],
    "bike": ["bicycle", "motorcycle"],
    "bicycle": ["bicycle"],
    "person": ["person", "pedestrian"],
    "people": ["person", "pedestrian"],
    "pedestrian": ["pedestrian", "person"],
    "man": ["person"],
    "woman": ["person"],
    "child": ["person"],
    "cat": ["cat"],
    "dog": ["dog"],
    "umbrella": ["umbrella"],
    "phone": ["cell phone", "phone"],
    "mobile": ["cell phone", "phone"],
    "cellphone": ["cell phone", "phone"],
    "laptop": ["laptop", "computer"],
    "computer": ["computer", "laptop"],
    "screen": ["screen", "monitor"],
    "monitor": ["monitor", "screen", "computer monitor"],
    "keyboard": ["keyboard"],
    "mouse": ["mouse"],
    "mice": ["mouse"],
    "chair": ["chair"],
    "table": ["table", "desk"],
    "desk": ["desk", "table"],
    "bottle": ["bottle", "water bottle"],
    "bottles": ["bottle", "water bottle", "juice bottle"],
    "cup": ["cup", "mug"],
    "mug": ["mug", "cup"],
    "book": ["book"],
    "door": ["door"],
    "window": ["window"],
    "clock": ["clock"],
    "fan": ["fan"],
    "light": ["light"],
    "juice": ["juice box", "juice bottle"],
    "juicebox": ["juice box"],
    "frooti": ["juice box"],
    "speaker": ["bluetooth speaker", "speaker"],
    "bluetooth": ["bluetooth speaker"],
    "charger": ["phone charger", "charger", "power bank"],
    "can": ["soda can", "can", "energy drink can"],
    "soda": ["soda can", "can"],
    "monster": ["soda can", "energy drink can"],
    "powerbank": ["power bank"],
    "extension": ["extension board"],
}

# --- Fixed values. Where a question names a place; the first pattern that matches wins.
PLACE_PATTERNS = [
    r"\b(?:at|near|in|by|around|towards|through)\s+(?:the\s+)?([a-zA-Z0-9_\-]+(?:\s+[a-zA-Z0-9_\-]+)*)\b",
    r"\bcamera\s+([a-zA-Z0-9_\-]+)\b",
    r"\b(cam_[a-zA-Z0-9_\-]+)\b",
]

# --- Fixed values. Wording removed from a question to leave the object.
FILLER_PATTERNS = [
    r"^(?:did\s+(?:a|any|the)|was\s+there\s+(?:a|any)|were\s+there\s+(?:any)|is\s+there\s+(?:a|any)"
    r"|show\s+(?:me\s+)?(?:all\s+)?|find\s+(?:all\s+)?|search\s+(?:for\s+)?|have\s+you\s+seen\s+(?:a|any))\s+",
    r"\b(?:pass(?:ed|ing)?|walk(?:ed|ing)?|enter(?:ed|ing)?|appear(?:ed|ing)?|cross(?:ed|ing)?)\b",
    r"\?+$",
]

# --- Fixed values. Time phrases, in the order they are tried.
LAST_MINUTES = r"\b(?:in\s+the\s+)?(?:last|past)\s+(\d+)\s*(?:minutes|mins|minute|min)\b"
LAST_HOURS = r"\b(?:in\s+the\s+)?(?:last|past)\s+(\d+)\s*(?:hours|hrs|hour|hr)\b"
LAST_HOUR = r"\b(?:in\s+the\s+)?(?:last|past)\s+hour\b"
TODAY = r"\btoday\b"
YESTERDAY = r"\byesterday\b"
MORNING = r"\b(?:this\s+morning|in\s+the\s+morning)\b"
AFTERNOON = r"\b(?:this\s+afternoon|in\s+the\s+afternoon)\b"
EVENING = r"\b(?:this\s+evening|in\s+the\s+evening)\b"
BETWEEN_12H = (
    r"\bbetween\s+(\d{1,2})(?::(\d{2}))?\s*(am|pm)?\s+and\s+(\d{1,2})(?::(\d{2}))?\s*(am|pm)\b"
)
BETWEEN_24H = r"\bbetween\s+(\d{1,2}):(\d{2})\s+and\s+(\d{1,2}):(\d{2})\b"
ISO_INSTANT = r"(\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}:\d{2})"

# --- Fixed values. Coarse object groups.
PERSON_LABELS = [
    "person", "pedestrian", "cyclist", "child", "security guard", "delivery worker", "construction worker",
]
VEHICLE_LABELS = [
    "car", "sedan", "suv", "van", "pickup truck", "truck", "semi-truck", "bus", "motorcycle", "motorbike",
    "bicycle", "electric scooter", "autorickshaw", "ambulance", "police car", "fire truck", "forklift",
]

# --- Fixed values. Colour words of a question that move its scores.
QUERY_COLOURS = [
    "red", "blue", "green", "yellow", "black", "white", "silver", "grey", "orange", "brown", "purple", "pink",
]
CHROMATIC = ["red", "blue", "green", "yellow", "orange", "brown", "purple", "pink"]

# --- Fixed values. Detected colour -> words that ask for it.
COLOUR_WORDS = {
    "red": ["red", "maroon", "crimson", "burgundy"],
    "blue": ["blue", "navy", "cyan", "azure"],
    "green": ["green", "lime", "emerald"],
    "yellow": ["yellow", "gold"],
    "white": ["white"],
    "black": ["black", "dark"],
    "silver/gray": ["silver", "gray", "grey"],
    "orange": ["orange"],
}

# --- Fixed values. Colour centres in 8-bit Lab (L, a, b); 128 is neutral.
LAB_CENTRES = [
    ("black", 25.0, 128.0, 128.0),
    ("white", 245.0, 128.0, 128.0),
    ("grey", 128.0, 128.0, 128.0),
    ("silver", 195.0, 128.0, 128.0),
    ("red", 136.0, 208.0, 195.0),
    ("red", 80.0, 190.0, 165.0),
    ("blue", 82.0, 207.0, 20.0),
    ("blue", 40.0, 170.0, 50.0),
    ("blue", 140.0, 150.0, 70.0),
    ("green", 210.0, 45.0, 205.0),
    ("green", 100.0, 60.0, 165.0),
    ("yellow", 240.0, 110.0, 220.0),
    ("orange", 175.0, 165.0, 200.0),
    ("brown", 96.0, 154.0, 169.0),
    ("purple", 110.0, 200.0, 85.0),
    ("pink", 190.0, 185.0, 145.0),
]

# --- Fixed values. Truth label -> result labels accepted for it (besides itself).
TRUTH_SYNONYMS = {
    "car": ["car", "van", "suv"],
    "van": ["car", "van", "suv"],
    "suv": ["car", "van", "suv"],
    "truck": ["truck", "bus"],
    "bus": ["bus", "truck"],
    "person": ["person", "pedestrian"],
    "pedestrian": ["person", "pedestrian"],
    "motorcycle": ["motorcycle", "motorbike"],
    "motorbike": ["motorcycle", "motorbike"],
    "cat": ["cat", "animal"],
}

# --- Fixed values. Camera -> what people call it.
SPOKEN_CAMERAS = {
    "cam_landscape": [
        "landscape", "cam landscape", "camera landscape", "landscape camera",
        "landscape one", "landscape 1", "cam landscape 1", "cam landscape one",
    ],
    "cam_landscape2": [
        "landscape two", "landscape 2", "cam landscape two", "cam landscape 2",
        "landscape two camera", "landscape 2 camera", "second landscape",
    ],
    "test_video01": [
        "test video one", "test video 1", "video one", "video 1", "test video", "first test video", "test video 01",
    ],
    "test_video02": [
        "test video two", "test video 2", "video two", "video 2", "second test video", "test video 02",
    ],
    "test_video03": [
        "test video three", "test video 3", "video three", "video 3", "third test video", "test video 03",
    ],
    "mobile_cam01": [
        "mobile cam one", "mobile cam 1", "mobile camera one", "mobile 1", "mobile one", "phone camera",
        "mobile cam 01",
    ],
    "mobile_cam02": [
        "mobile cam two", "mobile cam 2", "mobile camera two", "mobile 2", "mobile two", "mobile cam 02",
    ],
    "mobile_cam03": [
        "mobile cam three", "mobile cam 3", "mobile camera three", "mobile 3", "mobile three", "mobile cam 03",
    ],
}
CAMERA_SPOKEN_NAMES = {
    "cam_landscape": "landscape",
    "cam_landscape2": "landscape two",
    "test_video01": "test video one",
    "test_video02": "test video two",
    "test_video03": "test video three",
    "mobile_cam01": "mobile cam one",
    "mobile_cam02": "mobile cam two",
    "mobile_cam03": "mobile cam three",
}
SPOKEN_PREFIXES = ["say ", "it is ", "it s ", "camera ", "the ", "at "]

# --- Fixed values. Spoken camera mention -> camera, applied in order.
_PLACE = r"\b(?:at|near|in|by|around)?\s*(?:the\s+)?"
SPOKEN_REWRITES = [
    (_PLACE + r"(?:cam\s+)?landscape\s*(?:two|2)(?:\s+camera)?\b", "at cam_landscape2"),
    (_PLACE + r"(?:cam\s+)?landscape(?:\s+camera|\s+(?:one|1))?\b", "at cam_landscape"),
    (_PLACE + r"test\s+video\s*(?:one|1|01)\b", "at test_video01"),
    (_PLACE + r"test\s+video\s*(?:two|2|02)\b", "at test_video02"),
    (_PLACE + r"test\s+video\s*(?:three|3|03)\b", "at test_video03"),
    (_PLACE + r"mobile\s+cam\s*(?:one|1|01)\b", "at mobile_cam01"),
    (_PLACE + r"mobile\s+cam\s*(?:two|2|02)\b", "at mobile_cam02"),
    (_PLACE + r"mobile\s+cam\s*(?:three|3|03)\b", "at mobile_cam03"),
]
DOUBLED_PREPOSITION = r"\b(?:at|in|near)\s+(at|in|near)\b"

# --- Fixed values. Words in a raw detector label -> label, in order; see text.detector_label.
DETECTOR_KEYWORDS = [
    (["extension", "power strip"], "extension board"),
    (["power bank"], "power bank"),
    (["charger", "adapter"], "phone charger"),
    (["speaker"], "bluetooth speaker"),
    (["monitor", "display"], "computer monitor"),
    (["laptop", "notebook"], "laptop"),
    (["soda"], "soda can"),
    (["water", "bottle"], "water bottle"),
]

# --- Fixed values. File name time patterns: with camera prefix (compact, dashed), then bare.
_CAM = r"([a-zA-Z0-9_\-]+?)_?"
FILE_TIME_PATTERNS = [
    (_CAM + r"(\d{4})(\d{2})(\d{2})[_\-T](\d{2})(\d{2})(\d{2})", True),
    (_CAM + r"(\d{4})-(\d{2})-(\d{2})[_\-T](\d{2})[:-](\d{2})[:-](\d{2})", True),
    (r"(\d{4})(\d{2})(\d{2})[_\-T](\d{2})(\d{2})(\d{2})", False),
]
