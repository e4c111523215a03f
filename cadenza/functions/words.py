"""Fixed values of the text operators: word lists, term tables, weights and phrases."""

# fixed values
POSITIVE = ["amazing", "excellent", "great", "good", "love", "beautiful", "stunning"]
NEGATIVE = ["terrible", "bad", "awful", "poor", "hate", "dislike", "annoying"]
STOP_WORDS = ["the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "with"]
CATEGORIES = {
    "production": ["mix", "master", "production", "sound", "quality", "audio"],
    "emotional": ["dark", "bright", "atmospheric", "aggressive", "mellow", "intense"],
    "musical": ["rhythm", "melody", "harmony", "beat", "bassline", "progression"],
    "genre": ["neurofunk", "drum and bass", "techno", "house", "ambient"],
}
EMOTIONAL_TERMS = {
    "dark": ["dark", "darkness", "gloomy", "sinister", "ominous"],
    "bright": ["bright", "brightness", "uplifting", "cheerful", "happy"],
    "aggressive": ["aggressive", "hard", "intense", "angry", "heavy"],
    "atmospheric": ["atmospheric", "ambient", "spacious", "ethereal"],
    "deep": ["deep", "depth", "low", "bass", "sub"],
    "rolling": ["rolling", "flowing", "smooth", "liquid"],
}
TECHNICAL_TERMS = {
    "bass_energy": ["bass", "low end", "sub"],
    "spectral_centroid": ["bright", "dark", "tone", "tonal"],
    "percussion_intensity": ["drums", "percussion", "beats", "rhythm"],
    "stereo_width": ["stereo", "width", "wide", "spatial"],
    "reese_bass": ["reese", "bass", "modulation", "wobble"],
}
INTENSITY = {0.9: ["very", "extremely", "incredibly"], 0.7: ["quite", "rather", "fairly"], 0.5: ["slightly", "somewhat"], 0.2: ["not", "barely", "hardly"]}
COMPARE = ["compare", "difference", "versus", " vs "]
RECOMMEND = ["recommend", "suggest"]
CAPTION_WORDS = {
    "positive": ["happy", "upbeat", "cheerful", "joyful", "pleasant", "bright", "energetic", "uplifting", "exciting", "relaxing", "beautiful", "harmonious", "smooth", "peaceful"],
    "negative": ["sad", "depressing", "dark", "gloomy", "ominous", "tense", "aggressive", "harsh", "noisy", "chaotic", "disturbing", "anxious", "frightening", "distorted"],
    "neutral": ["ambient", "calm", "steady", "neutral", "moderate", "average", "standard", "typical", "ordinary", "regular"],
}
LEVEL_PHRASES = {
    "energy": ("relaxed and calm", "moderately energetic", "highly energetic and intense"),
    "brightness": ("dark and subdued", "balanced brightness", "bright and vibrant"),
    "tension": ("relaxed and resolved", "moderately tense", "highly tense and unresolved"),
    "warmth": ("cold and clinical", "moderately warm", "very warm and rich"),
    "groove": ("rigid and mechanical", "moderately groovy", "deeply groovy and flowing"),
    "aggression": ("gentle and soft", "moderately aggressive", "highly aggressive and hard-hitting"),
    "atmosphere": ("direct and immediate", "moderately atmospheric", "deeply atmospheric and immersive"),
    "melancholy": ("upbeat and positive", "slightly melancholic", "deeply melancholic and emotional"),
    "euphoria": ("grounded and serious", "moderately uplifting", "euphoric and ecstatic"),
}
