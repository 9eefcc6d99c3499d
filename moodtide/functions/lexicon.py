"""Word lists and maps that results depend on."""

# Entries that repeat count as often as they stand here.
POSITIVE_WORDS = (
    "great awesome amazing wonderful fantastic excellent love loved best good nice happy excited thrilled brilliant perfect incredible outstanding superb marvelous "
    "delighted pleased satisfied impressed grateful blessed fortunate lucky successful victory win achievement progress improvement breakthrough innovation creative "
    "inspiring motivating encouraging hopeful optimistic confident proud celebrate cheer smile laugh joy fun enjoy wonderful beautiful gorgeous stunning magnificent "
    "spectacular breathtaking inspiring uplifting positive upbeat cheerful bright sunny warm cozy comfortable peaceful calm serene tranquil relaxed refreshed renewed "
    "rejuvenated energized vibrant alive thriving flourishing prosperous successful accomplished fulfilled content satisfied grateful thankful appreciative blessed "
    "fortunate lucky privileged honored proud accomplished achieved succeeded won victory triumph conquest breakthrough milestone landmark record best top peak summit "
    "climax pinnacle zenith acme apex crown jewel gem treasure prize reward gift blessing miracle wonder marvel phenomenon extraordinary exceptional remarkable notable "
    "significant important valuable precious cherished beloved adored treasured esteemed respected admired revered worshiped idolized hero champion winner leader "
    "pioneer trailblazer innovator creator artist genius master expert professional skilled talented gifted brilliant intelligent wise smart clever sharp quick fast "
    "efficient effective productive successful profitable beneficial helpful useful valuable worthwhile meaningful purposeful significant important essential crucial "
    "vital critical key main primary principal chief leading top first best greatest highest maximum optimal perfect ideal excellent outstanding superior premium "
    "quality high-quality top-notch first-class world-class"
).split()

# Fixed values, as above.
NEGATIVE_WORDS = (
    "bad terrible awful horrible disgusting hate hated worst evil nasty sad angry mad furious rage frustrated annoyed irritated upset disappointed devastated crushed "
    "broken hurt pain suffering agony torment torture nightmare disaster catastrophe tragedy crisis emergency danger threat risk fear afraid scared terrified panic "
    "anxiety worry concern stress pressure tension strain burden load weight heavy difficult hard tough challenging struggle battle fight war conflict dispute argument "
    "quarrel fight brawl violence aggression hostility anger rage fury wrath indignation resentment bitterness hatred loathing disgust revulsion repulsion abhorrence "
    "detestation aversion antipathy hostility animosity enmity malice spite venom poison toxic harmful damaging destructive ruinous devastating catastrophic tragic sad "
    "sorrowful mournful melancholy depressed dejected despondent gloomy bleak dark dismal dreary miserable wretched pitiful pathetic lamentable regrettable unfortunate "
    "unlucky cursed doomed fated destined inevitable unavoidable inescapable hopeless helpless powerless weak feeble frail fragile vulnerable exposed defenseless "
    "unprotected unsafe dangerous risky hazardous perilous precarious unstable shaky uncertain doubtful suspicious skeptical cynical pessimistic negative downbeat"
).split()

# Keyword and topic.
TOPICS = {
    "tech": "technology", "ai": "artificial intelligence", "crypto": "cryptocurrency", "climate": "climate change", "politics": "politics",
    "news": "news", "music": "music", "art": "art", "science": "science", "health": "health",
}

# Mood words from the most negative to the most positive.
MOOD_WORDS = (
    "hopeless devastated shattered destroyed ruined distressed anguished tormented crushed broken angry furious enraged livid outraged upset disturbed agitated "
    "perturbed unsettled frustrated exasperated annoyed irritated bothered disappointed let-down disheartened discouraged dejected worried anxious uneasy concerned "
    "troubled apprehensive nervous edgy tense restless cautious wary guarded reserved hesitant indifferent apathetic unmoved detached neutral calm peaceful serene "
    "tranquil composed pleased satisfied content gratified fulfilled cheerful upbeat bright sunny optimistic happy joyful glad delighted merry excited enthusiastic "
    "eager thrilled elated ecstatic overjoyed joyous rapturous exultant exhilarated exuberant vibrant energetic lively jubilant triumphant victorious celebratory "
    "festive transcendent blissful divine heavenly sublime euphoric magnificent glorious radiant exalted"
).split()

#: A small valence lexicon of our own for the rule-based scorer; a larger one may be given as a table (word, valence).
SEED_VALENCES = {
    "love": 3.2, "amazing": 2.8, "great": 3.1, "good": 1.9, "happy": 2.7, "best": 3.2, "nice": 1.8, "excellent": 2.7, "awesome": 3.1, "wonderful": 2.7, "fantastic": 2.6,
    "beautiful": 2.9, "enjoy": 2.2, "fun": 2.3, "win": 2.8, "hope": 1.9, "thanks": 1.9, "perfect": 2.7, "brilliant": 2.8, "proud": 2.1, "okay": 0.9, "like": 1.5,
    "terrible": -2.1, "hate": -2.7, "awful": -2.0, "horrible": -2.5, "bad": -2.5, "worst": -3.1, "sad": -2.1, "angry": -2.3, "disgusting": -2.4, "fear": -2.2, "pain": -2.3,
    "war": -2.9, "evil": -3.4, "disaster": -3.1, "fail": -2.5, "ugly": -2.3, "stupid": -2.4, "idiot": -2.3, "pathetic": -2.6, "worthless": -1.9, "moron": -2.2, "nasty": -2.6,
}
