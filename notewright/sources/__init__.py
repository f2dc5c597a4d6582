"""Sources and sinks: the karaoke text format, WAV, MIDI, MusicXML."""
