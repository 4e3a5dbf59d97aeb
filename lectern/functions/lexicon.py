"""Word lists and patterns of the transcript contract. They are data; nothing here is logic."""

# fixed values: filler tokens (a whole token, any case)
FILLER = r"u+h+|huh|m+|h+m+|erm+|um+|ah+|eh+|yeah+|yea+h*|yep|okay|ok"
# fixed values: stage words that make a bracketed span a stage direction
STAGE_WORDS = r"laugh|laughter|cough|sigh|pause|tape|phone|door|noise|inaudible|overlap|side\s+(?:one|two)|end\s+of"
# fixed values: interviewer backchannels, as phrases and as tokens
BACKCHANNEL_PHRASES = (
    "absolutely", "exactly", "fine", "good", "i know", "i see", "no", "no no", "of course", "ok", "okay", "right", "right right", "so",
    "sure", "that is right", "that's right", "very good", "well", "yeah", "yeah yeah", "yep", "yes", "yes yes",
)
BACKCHANNEL_TOKENS = (
    "absolutely", "course", "exactly", "fine", "good", "i", "is", "it", "know", "no", "of", "ok", "okay", "right", "see", "so", "sure", "that",
    "that's", "very", "well", "yeah", "yep", "yes",
)
# fixed values: acknowledgements
ACKNOWLEDGEMENT_TOKENS = (
    "absolutely", "ah", "aye", "definitely", "eh", "erm", "exactly", "fine", "good", "ha", "hm", "hmm", "huh", "indeed", "laughter", "laughs",
    "mm", "mmm", "no", "oh", "ok", "okay", "quite", "really", "right", "so", "sure", "true", "um", "well", "yeah", "yea", "yep", "yer", "yes",
)
ACKNOWLEDGEMENT_PHRASES = (
    "it is", "it is yeah", "it was", "no not at all", "not at all", "that is right", "that is right yeah", "that is true", "that's right", "that's right yeah",
)
# fixed values: answers without information
NO_INFORMATION_PHRASES = (
    "can't remember", "cannot remember", "do not know", "don't know", "i can't remember", "i cannot remember", "i do not know", "i don't know",
    "i know", "i mean", "it depends", "not really", "you know",
)
NO_INFORMATION = r"^(?:i\s+)?(?:really\s+)?(?:do\s+not|don't|cannot|can't|can\s+not)\s+(?:really\s+)?(?:know|remember)$"
# fixed values: discourse words that an echo may add
ECHO_TOKENS = (
    "absolutely", "ah", "aye", "definitely", "erm", "exactly", "hm", "hmm", "huh", "mm", "mmm", "oh", "ok", "okay", "right", "sure", "um", "well",
    "yeah", "yea", "yep", "yer", "yes",
)
# fixed values: claims
PRONOUNS = ("he", "i", "it", "she", "they", "there", "we", "you")
FINITE_VERBS = (
    "am are became becomes buy buys can clean cleans cook cooks could depends did disagree disagrees do does drive drives feel feels felt "
    "found gave get gets go goes got had has have is knew know left like likes live lives look looks made may mean means meet meets met might "
    "move moves must need needs own owns pay pays prefer prefers remember remembers rent rents said sell sells seem seems shall should stay "
    "stays take takes think thinks thought took walk walks want wants was were will work works would"
).split()
# fixed values: words a finished sentence does not end with
HARD_CUTOFF = ("although", "and", "because", "but", "or", "whereas")
CONTINUATION = (
    *HARD_CUTOFF, "a", "an", "are", "can", "could", "did", "do", "does", "for", "from", "had", "has", "have", "her", "his", "is", "may", "might",
    "must", "my", "of", "our", "should", "the", "their", "to", "was", "were", "will", "with", "would", "your",
)
# fixed values: order of rejection reasons
REJECTIONS = ("no_clear_evidence", "acknowledgement_or_no_information", "question_echo", "short_fragment", "clear_cutoff")
# fixed values: order of review reasons, evaluation words, management questions
REVIEW_REASONS = ("very_short", "explicitly_unfinished", "unclear_or_damaged", "interview_management", "participant_question", "bare_evaluation")
EVALUATION = (
    "amazing awful bad best brilliant difficult easier easy fantastic fine flexible good great happy hard horrible incredible love lovely nice "
    "perfect romantic stressful terrible unhappy wonderful wonderfully worse worst"
).split()
MANAGEMENT = (
    r"\bare you funded\b|\bwhat (?:are you|will you) going to do with\b|\bhow many responses\b|\bresponse rate\b|\bsee (?:the )?(?:research|results)\b|"
    r"\bopportunity to see\b|\bwhat time is it\b|\blate for (?:them|the interview)\b|\bwhen do you go back\b|\bhow long are you (?:here|around)\b|"
    r"\bquestions? (?:for|about) (?:me|the research)\b|\btape (?:turned|is) off\b"
)
# fixed values: speaker labels -> (role, canonical label, may be a target)
SPEAKERS = {
    "Q": ("interviewer", "Interviewer", False), "I": ("interviewer", "Interviewer", False), "IV": ("interviewer", "Interviewer", False), "IE": ("interviewer", "Interviewer", False),
    "MALE": ("participant", "Male", True), "M": ("participant", "Male", True), "MALEALE": ("participant", "Male", True), "MASLE": ("participant", "Male", True),
    "FEMALE": ("participant", "Female", True), "F": ("participant", "Female", True), "FEMAIL": ("participant", "Female", True),
    "IE1": ("participant", "Incidental", False), "IE2": ("participant", "Incidental", False), "YO1": ("participant", "Incidental", False),
}
