"""Word lists. Frequent words of five languages."""

from __future__ import annotations

#: A few dozen function words of each language, in the order of a usual frequency list.
FUNCTION_WORDS = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so zum war haben nur oder aber vor".split(),
    "en": "the of and to in a is that it was for on with as at by be this have from or had but not are which were they their been has would there what all if when who will more no out so said can about after".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy hasta desde nos".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec mais ou on son aux d une été cette elle à leur comme nous si même sans".split(),
    "pt": "de a o que e do da em um para é com não uma os no se na por mais as dos como mas foi ao ele das tem à seu sua ou ser quando muito há nos já está eu também só pelo pela até isso ela entre era depois sem mesmo".split(),
}
